"""Steps that turn job-run pages into run/task events.

Rows carry the run in one struct column ``job`` (with a single object ``job.tasks``
after the split) and get further top-level columns on the way.  Every step is narrow
except ``dedup_terminated``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.durations import cutoff_ms, positive_ms_to_timestamp
from tidewatch.functions.nesting import field_or_null, leaf_paths, nest
from tidewatch.operators.sequences import CROWD, dealt
from tidewatch.schema.fixed_values import (
    CLOUD_HOSTS,
    ECS_VERSION,
    EVENT_CATEGORY,
    EVENT_KIND,
    EVENT_TYPE,
    JOB_DATASET,
    JOB_ERROR_PREFIX,
    JOB_STREAM_TYPE,
    KEEP_ORIGINAL_TAG,
    MODULE,
    NO_CLUSTER,
    OUTCOMES,
    REQUEST_INTERVAL,
    TERMINATED,
)
from tidewatch.schema.job_leaves import JOB_LEAVES
from tidewatch.schema.source_types import CORRUPT, RUN_FIELDS, RUN_TASK

FLAG = "is_within_interval_range"


def split_runs(pages: DataFrame) -> DataFrame:
    """One row per run of each page; other page columns stay.

    Runs of a page that could not be read in full carry ``decode_error``; if none could be
    read, the page stays as one row without a run.
    """
    if CORRUPT not in pages.columns:
        return pages.select(*(c for c in pages.columns if c != "runs"), F.inline("runs"))
    unread = F.col(CORRUPT).isNotNull()
    no_run = F.array(F.lit(None).cast(pages.schema["runs"].dataType.elementType))
    listed = F.when(unread & (F.coalesce(F.size("runs"), F.lit(0)) < 1), no_run)
    others = [c for c in pages.columns if c not in ("runs", CORRUPT, "decode_error")]
    return pages.select(
        *others,
        F.when(unread, "page is not readable as declared").alias("decode_error"),
        F.inline(F.coalesce(listed, "runs")),
    )


def split_tasks(runs: DataFrame) -> DataFrame:
    """One row per task, the run's own columns kept; a run without tasks stays, task null."""
    others = [c for c in runs.columns if c != "tasks"]
    return runs.select(*others, F.explode_outer("tasks").alias("tasks"))


def as_job(df: DataFrame) -> DataFrame:
    """Gather the run's columns in the struct ``job``."""
    others = [c for c in df.columns if c not in RUN_FIELDS]
    return df.select(*others, F.struct(*(c for c in df.columns if c in RUN_FIELDS)).alias("job"))


def encode_message(df: DataFrame, col: str = "message") -> DataFrame:
    """Gather the run's columns as JSON text in ``col``, as an agent ships them."""
    others = [c for c in df.columns if c not in RUN_FIELDS]
    fields = [c for c in df.columns if c in RUN_FIELDS]
    return df.select(*others, F.to_json(F.struct(*fields)).alias(col))


def decode_json(
    df: DataFrame, col: str = "message", target: str = "job", schema: str = RUN_TASK
) -> DataFrame:
    """Parse JSON text into ``target``, two levels deep.

    The text is parsed once to a variant, which tells whether it can be read.  Where all of it is as
    declared (``_as_declared``), values are read from the text by ``from_json``; of other texts, fields
    are taken from the variant, one by one: a number in quotes is a number, and an object or array one
    level down may also come as JSON text, which is parsed then.  Both give the same where both apply.
    A ``target`` that is already there wins.  ``decode_error`` tells why a text, or which field of it,
    could not be read; fields that could be read are kept.
    """
    fields = T.StructType.fromDDL(schema).fields
    nested = [f for f in fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    plain = [f for f in fields if f not in nested]
    top = T.StructType([*plain, *(T.StructField(f.name, T.VariantType()) for f in nested)])
    # Bound one after the other as columns, so that no text is parsed and no value taken again.
    read = df.withColumn("_parsed", F.try_parse_json(col))
    read = _as_declared(read, col, fields)
    odd = F.col("_odd").isNotNull()
    read = read.withColumn("_fields", _taken("_odd", top))
    read = read.withColumns(
        {f"_own_{f.name}": _taken(f"_fields.{f.name}", f.dataType) for f in nested}
    )
    read = read.withColumns({f"_text_{f.name}": _text_of(f.name) for f in nested})
    read = read.withColumns({f"_inner_{f.name}": F.try_parse_json(f"_text_{f.name}") for f in nested})
    values, wrong = {}, _misfits(F.col("_fields"), plain, ["_odd"])
    for f in nested:
        value = F.coalesce(f"_own_{f.name}", _taken(f"_inner_{f.name}", f.dataType))
        read = read.withColumn(f"_value_{f.name}", value)
        values[f.name] = F.col(f"_value_{f.name}")
        unread = F.col(f"_text_{f.name}").isNotNull() & values[f.name].isNull()
        if isinstance(f.dataType, T.StructType):
            sources = [f"_fields.{f.name}", f"_inner_{f.name}"]
            unread |= F.size(_misfits(values[f.name], f.dataType.fields, sources)) > 0
        wrong = F.concat(wrong, F.array(F.when(unread, f.name)))
    decoded = F.struct(*(values.get(f.name, F.col(f"_fields.{f.name}")).alias(f.name) for f in fields))
    taken = F.col("_fields").isNotNull()
    declared = F.struct(*(F.col(f"_typed.{f.name}").alias(f.name) for f in fields))
    value = F.when(F.col("_declared"), declared).when(taken, decoded)
    if target in df.columns:
        value = F.coalesce(F.col(target), value)
    misfits = F.array_sort(F.array_compact(F.when(odd, wrong)))
    read = read.withColumn("_misfits", misfits)
    told = F.concat(F.array_join("_misfits", ", "), F.lit(f" of {col} cannot be read"))
    lost = F.col(col).isNotNull() & ~F.col("_declared") & ~taken
    error = F.when(lost, F.lit(f"{col} is not a JSON object"))
    error = error.when(taken & (F.size("_misfits") > 0), told)
    kept = [c for c in df.columns if c not in (target, "decode_error")]
    return read.select(*kept, value.alias(target), error.alias("decode_error"))


# Stands between strings, and what a string begins with, or is, that may have been no string.
_BETWEEN = "\x01"
_NO_STRING = f"{_BETWEEN}([{{\\[]|-?[0-9][-+.0-9eE]*{_BETWEEN})"


def _as_declared(read: DataFrame, col: str, fields: Sequence[T.StructField]) -> DataFrame:
    """Add ``_typed``, ``_declared`` and, of the other texts, the variant as ``_odd``.

    ``_declared`` is a JSON object whose fields all have just the declared type, so that there is
    only one way to read it: ``from_json`` found nothing amiss in ``_typed``, the text is one that
    parses to a variant (no key occurs twice), and no string may have been given as a number, object
    or array, whose text ``from_json`` copies.
    """
    leaves = _leaves(fields)
    if not all(isinstance(t, (T.LongType, T.StringType, T.BooleanType)) for t in leaves.values()):
        none = F.lit(None).cast(T.StructType(list(fields)))
        return read.withColumns({"_typed": none, "_declared": F.lit(False), "_odd": F.col("_parsed")})
    amiss = T.StructField(CORRUPT, T.StringType())
    options = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    typed = F.from_json(col, T.StructType([*fields, amiss]), options)
    # An object as text is none that from_json takes; this is only to spare the trial.
    tried = F.col("_parsed").isNotNull() & ~F.col(col).contains('"{\\"')
    read = read.withColumn("_typed", F.when(tried, typed))
    strings = [F.col(f"_typed.{path}") for path, t in leaves.items() if isinstance(t, T.StringType)]
    doubtful = F.concat(F.lit(_BETWEEN), F.concat_ws(_BETWEEN, *strings), F.lit(_BETWEEN))
    declared = (
        F.col("_typed").isNotNull()
        & F.col(f"_typed.{CORRUPT}").isNull()
        & F.ltrim(F.col(col), F.lit(" \t\r\n")).startswith("{")
        & ~doubtful.rlike(_NO_STRING)
    )
    read = read.withColumn("_declared", F.coalesce(declared, F.lit(False)))
    return read.withColumn("_odd", F.when(~F.col("_declared"), F.col("_parsed")))


def _leaves(fields: Sequence[T.StructField], above: str = "") -> dict[str, T.DataType]:
    """Types of the fields, and of those of structs, by path."""
    found = {}
    for f in fields:
        if isinstance(f.dataType, T.StructType):
            found |= _leaves(f.dataType.fields, f"{above}`{f.name}`.")
        else:
            found[f"{above}`{f.name}`"] = f.dataType
    return found


def _taken(variant: str, as_: T.DataType) -> Column:
    """The variant as this type, null where it does not fit; a field that does not is null alone."""
    return F.try_variant_get(F.col(variant), "$", as_.simpleString())


def _text_of(name: str) -> Column:
    """What stands where an object or array was declared; null for a JSON null."""
    text = F.try_variant_get(F.col(f"_fields.{name}"), "$", "string")
    return F.when(F.col(f"_own_{name}").isNull(), text)


def _misfits(value: Column, fields: Sequence[T.StructField], sources: Sequence[str]) -> Column:
    """Names of the fields of ``value`` that are there in its variant and could not be read.

    Anything can be read as text.  Only where another field is null is it looked up what was given.
    """
    own = [f.name for f in fields if not isinstance(f.dataType, T.StringType)]
    none = F.array().cast("array<string>")
    if not own:
        return none
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in own])
    given = F.coalesce(*(_taken(source, as_text) for source in sources))
    missed = F.filter(
        F.array(*(F.when(value[name].isNull(), name) for name in own)), lambda name: name.isNotNull()
    )
    found = F.transform(
        F.array(given),
        lambda g: F.array(*(F.when(g[name].isNotNull() & value[name].isNull(), name) for name in own)),
    )
    return F.when(F.size(missed) > 0, F.array_compact(F.coalesce(found[0], none))).otherwise(none)


def flag_in_interval(
    df: DataFrame, now: datetime | Column, request_interval: str = REQUEST_INTERVAL
) -> DataFrame:
    """Whether the run ended within the last interval; unset for a run without tasks.

    ``now`` may be a column, such as the time a page was fetched.
    """
    ended = F.coalesce("job.end_time", F.lit(0))
    recent = ended >= F.lit(cutoff_ms(now, request_interval))
    return df.withColumn(FLAG, F.when(F.col("job.tasks").isNotNull(), recent))


def drop_stale(df: DataFrame) -> DataFrame:
    """Leave out terminated runs that ended before the interval; unknown values stay."""
    stale = (F.col("job.status.state") == TERMINATED) & ~F.col(FLAG)
    return df.filter(~F.coalesce(stale, F.lit(False)))


def drop_message(df: DataFrame) -> DataFrame:
    return df.drop("message")


def _update_job(df: DataFrame, **fields: Column) -> DataFrame:
    job = F.col("job")
    for name, column in fields.items():
        job = job.withField(name, column)
    return df.withColumn("job", job)


def duration_ms() -> Column:
    """Duration in ms from the epoch-ms start and end; the API's value for an open run."""
    start, end = F.col("job.start_time"), F.col("job.end_time")
    spent = F.coalesce(F.try_subtract(end, start), "job.run_duration")
    return F.when(start.isNotNull() & (end > 0), spent).otherwise(F.col("job.run_duration"))


def ms_to_time(df: DataFrame) -> DataFrame:
    """Start and end of the run from epoch ms to timestamps; zero and null give null."""
    return _update_job(
        df,
        start_time=positive_ms_to_timestamp(F.col("job.start_time")),
        end_time=positive_ms_to_timestamp(F.col("job.end_time")),
    )


def run_duration(df: DataFrame) -> DataFrame:
    """Set the run's duration; comes before ``ms_to_time``, since it works on the numbers."""
    return _update_job(df, run_duration=duration_ms())


def with_run_times(df: DataFrame) -> DataFrame:
    """``run_duration`` and ``ms_to_time`` at once, beside ``job`` instead of in it.

    Spark does not prune the fields of a rewritten struct, but drops columns nobody reads.
    """
    return df.withColumns(
        {
            "run_ms": duration_ms(),
            "run_start": positive_ms_to_timestamp(F.col("job.start_time")),
            "run_end": positive_ms_to_timestamp(F.col("job.end_time")),
        }
    )


def stamp_stream(
    df: DataFrame,
    type: str = JOB_STREAM_TYPE,
    dataset: str = JOB_DATASET,
    namespace: str = "default",
) -> DataFrame:
    return df.withColumn(
        "data_stream",
        F.struct(
            F.lit(type).alias("type"),
            F.lit(dataset).alias("dataset"),
            F.lit(namespace).alias("namespace"),
        ),
    )


def apply_tags(
    df: DataFrame, tags: Sequence[str] = (), preserve_original: bool = False
) -> DataFrame:
    """Tag list of the stream, the keep-original tag first when asked for."""
    names = ([KEEP_ORIGINAL_TAG] if preserve_original else []) + list(tags)
    column = F.array(*map(F.lit, names)) if names else F.lit(None)
    return df.withColumn("tags", column.cast("array<string>"))


def cluster_id(df: DataFrame) -> DataFrame:
    """Cluster of the run, else of its task, else the text for none; empty text is kept."""
    return df.withColumn(
        "cluster_id",
        F.coalesce(
            "job.cluster_instance.cluster_id",
            "job.tasks.cluster_instance.cluster_id",
            F.lit(NO_CLUSTER),
        ),
    )


def ecs_constants(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("ecs_version", F.lit(ECS_VERSION))
        .withColumn("event_kind", F.lit(EVENT_KIND))
        .withColumn("event_type", F.array(F.lit(EVENT_TYPE)))
        .withColumn("event_category", F.array(F.lit(EVENT_CATEGORY)))
        .withColumn("event_module", F.lit(MODULE))
        .withColumn("event_dataset", F.lit(JOB_DATASET))
    )


def event_times(
    df: DataFrame, start: str = "job.start_time", end: str = "job.end_time"
) -> DataFrame:
    """Event start and end from the run's times (timestamps or ISO text); bad text gives null."""

    def parsed(name: str) -> Column:
        column = F.col(name)
        type_ = df.select(column).schema[0].dataType
        if isinstance(type_, T.TimestampType):
            return column
        return F.try_to_timestamp(column.cast("string"))

    return df.withColumn("event_start", parsed(start)).withColumn("event_end", parsed(end))


def event_duration(df: DataFrame, duration: str = "job.run_duration") -> DataFrame:
    """Duration in ns for a positive duration in ms, else absent (also on overflow)."""
    ms = F.col(duration)
    return df.withColumn(
        "event_duration", F.when(ms > 0, F.try_multiply(ms, F.lit(1_000_000).cast("bigint")))
    )


def outcome(df: DataFrame) -> DataFrame:
    """Outcome of the three mapped result states; all others stay unset."""
    state = F.col("job.state.result_state")
    result = F.lit(None).cast("string")
    for name, value in OUTCOMES.items():
        result = F.when(state == name, value).otherwise(result)
    return df.withColumn("event_outcome", result)


def related_user(df: DataFrame) -> DataFrame:
    """Add the creator to ``related_user`` once; nothing changes without a creator."""
    creator = F.col("job.creator_user_name")
    before = F.col("related_user") if "related_user" in df.columns else F.lit(None)
    before = before.cast("array<string>")
    known = F.coalesce(before, F.array().cast("array<string>"))
    grown = F.when(F.array_contains(known, creator), known).otherwise(
        F.array_append(known, creator)
    )
    return df.withColumn("related_user", F.when(creator.isNotNull(), grown).otherwise(before))


def cloud_provider(df: DataFrame, host: str | Column) -> DataFrame:
    """Cloud told by the workspace host; of several matches the last one counts."""
    host = F.lit(host) if isinstance(host, str) else host
    cloud = F.lit(None).cast("string")
    for text, name in CLOUD_HOSTS.items():
        cloud = F.when(host.contains(text), name).otherwise(cloud)
    return df.withColumn("cloud_provider", cloud)


def drop_transient(df: DataFrame) -> DataFrame:
    return df.drop(FLAG, "message")


def retain_original(df: DataFrame, original: str = "event_original") -> DataFrame:
    """Keep the original text only under the keep-original tag."""
    return df.withColumn(
        original, F.when(F.array_contains("tags", KEEP_ORIGINAL_TAG), F.col(original))
    )


def capture_error(df: DataFrame, reason: str | Column) -> DataFrame:
    """Set ``error_message`` where ``reason`` is given; an earlier message stays, so does the row."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    message = F.concat(F.lit(JOB_ERROR_PREFIX), reason)
    if "error_message" in df.columns:
        message = F.coalesce("error_message", message)
    return df.withColumn("error_message", message)


def documented_ids(df: DataFrame) -> DataFrame:
    """Event id and user name, which the field list promises."""
    return df.withColumn("event_id", F.col("job.job_run_id").cast("string")).withColumn(
        "user_name", F.col("job.creator_user_name")
    )


def dedup_terminated(
    df: DataFrame,
    keys: Sequence[str] = ("job.job_run_id", "job.tasks.run_id"),
    poll: str = "poll",
    counted: bool = False,
) -> DataFrame:
    """One row per terminated run and task, from the first poll that saw it.

    A run is told by its job-run id, else by its run id.  Rows of runs that are still going
    or have no id all pass: each has a number of its own in the key.  The input is read
    once, and the ``= 1`` filter lets Spark keep one row per key before the shuffle, so a
    run repeated by many polls does not pile up in one task.

    That thinning sorts whole rows where they are read.  With ``counted`` the keys are counted first,
    in a read of their own; where copies are few and no key is crowded, rows are shuffled as they are,
    to as many tasks as their number asks for.
    """
    run, *rest = keys
    run = F.coalesce(F.col(run), F.col("job.run_id")) if run == "job.job_run_id" else F.col(run)
    ended = F.coalesce(F.col("job.status.state") == TERMINATED, F.lit(False)) & run.isNotNull()
    alone = F.when(~ended, F.monotonically_increasing_id())
    by = {"_run": run, **{f"_key_{n}": F.col(k) for n, k in enumerate(rest)}, "_alone": alone}
    rows = df.withColumns(by)
    if counted:
        key = F.when(ended, F.xxhash64(run, *(F.col(k) for k in rest)))
        n_rows, few_copies = _copies(df.select(key.alias("_key")))
        rows = dealt(rows, n_rows, list(by)) if few_copies else rows
    first = Window.partitionBy(*by).orderBy(poll)
    return (
        rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth", *by)
    )


# Buckets in which keys are counted.
_COUNTED = 4096


def _copies(keys: DataFrame) -> tuple[int, bool]:
    """Number of rows, and whether keys have fewer than two rows on average and none is crowded."""
    sizes = keys.groupBy(F.pmod("_key", F.lit(_COUNTED)).alias("_bucket")).agg(
        F.count("*").alias("_size"), F.approx_count_distinct("_key", 0.1).alias("_keys")
    )
    keyed = F.col("_bucket").isNotNull()
    found = sizes.agg(
        F.sum("_size"),
        F.sum(F.when(keyed, F.col("_size"))),
        F.sum("_keys"),
        F.max(F.when(keyed, F.col("_size"))),
    ).first()
    n_rows, n_keyed, n_keys, largest = (n or 0 for n in found)
    return n_rows, n_keyed < 2 * n_keys and largest <= CROWD + 4 * n_keyed / _COUNTED


# Columns the steps above add, under the path they have in the event table.
_ADDED = {
    "job.run_duration": "run_ms",
    "job.start_time": "run_start",
    "job.end_time": "run_end",
    "databricks.cluster_id": "cluster_id",
    "event.id": "event_id",
    "event.kind": "event_kind",
    "event.type": "event_type",
    "event.category": "event_category",
    "event.module": "event_module",
    "event.dataset": "event_dataset",
    "event.start": "event_start",
    "event.end": "event_end",
    "event.duration": "event_duration",
    "event.outcome": "event_outcome",
    "user.name": "user_name",
    "cloud.provider": "cloud_provider",
    "related.user": "related_user",
}

def enforce_job_schema(
    df: DataFrame, keep: Sequence[str] = (), nested: bool = True
) -> DataFrame:
    """The declared leaves with their declared types; a value that does not fit is null.

    Times still in epoch ms, as tasks have them, become timestamps.  ``keep`` names
    further columns to carry along.  Without ``nested`` the leaves are plain columns, the
    dots of their paths turned to underscores.
    """
    leaves = {}
    present = leaf_paths(df.schema)
    for leaf in JOB_LEAVES:
        source = _ADDED.get(leaf.path, leaf.path)
        source = source if source in present else leaf.path
        if leaf.type == "timestamp" and isinstance(present.get(source), T.IntegralType):
            column = positive_ms_to_timestamp(field_or_null(df, source, "bigint"))
        else:
            column = field_or_null(df, source, leaf.type)
        leaves[leaf.path] = column
    if not nested:
        flat = (c.alias(path.replace(".", "_")) for path, c in leaves.items())
        return df.select(*flat, *keep)
    units = {leaf.path: leaf.unit for leaf in JOB_LEAVES if leaf.unit}
    typed = df.select(*nest(leaves), *keep)
    for top in {path.split(".")[0] for path in units}:
        typed = typed.withMetadata(
            top,
            {"units": {p.split(".", 1)[1]: u for p, u in units.items() if p.startswith(f"{top}.")}},
        )
    return typed

"""Steps that turn JMX samples into typed metric events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import spark_interval
from tidewatch.functions.mbeans import (
    application_identity,
    bean_name,
    bean_type,
    driver_identity,
    executor_identity,
    last_token,
    matches_pattern,
    split_pattern,
)
from tidewatch.functions.nesting import field_or_null, nest
from tidewatch.schema.fixed_values import (
    DATASET_PREFIX,
    ECS_VERSION,
    EVENT_TYPE,
    METRIC_KIND,
    MODULE,
    OLD_DATASET_PREFIX,
    SHARED_DIMENSIONS,
)
from tidewatch.schema.metric_leaves import leaves_of, mapped_leaves

_CATALOGUE = (
    "stream string, field string, kind string, bean_type string, attribute string, "
    "pattern string, token string, exact boolean, head string, middle string, tail string"
)


def catalogue(spark: SparkSession, streams: Sequence[str] | None = None) -> DataFrame:
    """The name patterns as a table: at most 147 rows, so safe to broadcast."""
    rows = []
    for leaf in mapped_leaves():
        if streams is None or leaf.stream in streams:
            head, middle, tail = split_pattern(leaf.pattern)
            token = leaf.pattern.rsplit(".", 1)[-1]
            exact = "*" not in leaf.pattern
            rows.append(
                (leaf.stream, leaf.field, leaf.kind, leaf.bean_type, leaf.attribute)
                + (leaf.pattern, token, exact, head, middle, tail)
            )
    return spark.createDataFrame(rows, _CATALOGUE)


def match_catalogue(samples: DataFrame, streams: Sequence[str] | None = None) -> DataFrame:
    """Samples whose name and attribute fit a pattern, with stream, field and kind.

    One row per match: a driver's name may fit both the driver and the executor stream.
    The last dotted part of every pattern is literal, so the join is on equal keys, and
    only candidates with the same last part are compared further.
    """
    known = F.broadcast(catalogue(samples.sparkSession, streams))
    keyed = samples.withColumn("_name", bean_name(F.col("mbean"))).withColumn(
        "_bean_type", bean_type(F.col("mbean"))
    )
    fits = matches_pattern(
        F.col("_name"), known["exact"], known["head"], known["middle"], known["tail"]
    )
    joined = keyed.join(
        known,
        (last_token(F.col("_name")) == known["token"])
        & (F.col("_bean_type") == known["bean_type"])
        & (keyed["attribute"] == known["attribute"])
        & fits,
    )
    return joined.select(
        *(keyed[c] for c in samples.columns), known["stream"], known["field"], known["kind"]
    )


def as_payload(df: DataFrame) -> DataFrame:
    """Gather what the agent sent about a matched sample in the column ``jolokia``."""
    return df.withColumn("jolokia", F.struct("mbean", "field", "value", "status")).drop(
        "mbean", "field", "value", "status"
    )


def _typed(leaf, payload: str) -> Column:
    if leaf.type == "string":
        value = F.col(f"{payload}.status")
    else:
        value = F.col(f"{payload}.value").try_cast(leaf.type)
    return F.when(F.col(f"{payload}.field") == leaf.field, value)


def to_namespace(df: DataFrame, stream: str, payload: str = "jolokia") -> DataFrame:
    """Move the payload to ``databricks.<stream>``, one typed leaf per declared field.

    The metric name goes beside the values; leaves nobody collects are null.  Without a
    payload the column is null.
    """
    leaves = {}
    for leaf in leaves_of(stream):
        if leaf.kind == "dimension":
            is_name = leaf.path == "mbean"
            column = F.col(f"{payload}.mbean") if is_name else F.lit(None).cast("string")
        elif leaf.pattern is None:
            column = F.lit(None).cast(leaf.type)
        else:
            column = _typed(leaf, payload)
        leaves[leaf.field] = column
    (values,) = nest(leaves)
    return df.withColumn(
        "databricks", F.when(F.col(payload).isNotNull(), F.struct(values))
    )


def metric_constants(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("ecs_version", F.lit(ECS_VERSION))
        .withColumn("event_type", F.array(F.lit(EVENT_TYPE)))
        .withColumn("event_kind", F.lit(METRIC_KIND))
        .withColumn("event_module", F.lit(MODULE))
    )


def _with_identity(df: DataFrame, identity: Column) -> DataFrame:
    return df.withColumn("identity", identity)


def parse_driver_name(df: DataFrame, mbean: str = "databricks.driver.mbean") -> DataFrame:
    """Add ``identity`` (application_name, id, failure) of a driver-stream row."""
    return _with_identity(df, driver_identity(F.col(mbean)))


def parse_executor_name(df: DataFrame, mbean: str = "databricks.executor.mbean") -> DataFrame:
    """Add ``identity`` of an executor-stream row."""
    return _with_identity(df, executor_identity(F.col(mbean)))


def parse_application_name(
    df: DataFrame, mbean: str = "databricks.application.mbean"
) -> DataFrame:
    """Add ``identity`` of an application-stream row."""
    return _with_identity(df, application_identity(F.col(mbean)))


_IDENTITY_FIELDS = {
    "driver": {"application_name": "application_name"},
    "executor": {"application_name": "application_name", "id": "id"},
    "application": {"name": "application_name"},
}


def store_identity(df: DataFrame, stream: str) -> DataFrame:
    """Put the parsed names in ``databricks.<stream>``; rows that failed keep nulls."""
    column = F.col("databricks")
    for name, part in _IDENTITY_FIELDS[stream].items():
        column = column.withField(f"{stream}.{name}", F.col(f"identity.{part}"))
    return df.withColumn("databricks", column)


def metric_error(df: DataFrame, reason: str | Column = "identity.failure") -> DataFrame:
    """Set ``error_message`` where ``reason`` is given, over any earlier one; the row stays."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    if "error_message" in df.columns:
        return df.withColumn("error_message", F.coalesce(reason, "error_message"))
    return df.withColumn("error_message", reason)


def drop_payload(df: DataFrame, payload: str = "jolokia") -> DataFrame:
    """Clear the payload of rows that went through; error rows keep it."""
    return df.withColumn(
        payload, F.when(F.col("error_message").isNotNull(), F.col(payload))
    )


def node_row(matched: DataFrame, every: str | None = None) -> DataFrame:
    """The nine node metrics of one host and sample time (or ``every`` bucket) in one row."""
    leaves = leaves_of("node")
    at = F.window("ts", spark_interval(every)).start if every else F.col("ts")
    folded = (
        matched.filter(F.col("stream") == "node")
        .groupBy("host", at.alias("ts"))
        .pivot("field", [leaf.field for leaf in leaves])
        .agg(F.max("value"))
    )
    typed = {leaf.field: F.col(f"`{leaf.field}`").try_cast(leaf.type) for leaf in leaves}
    return folded.select("host", "ts", F.struct(*nest(typed)).alias("databricks"))


def wide_columns(stream: str) -> list[str]:
    """Column names ``wide_metrics`` gives for the stream's leaves."""
    return [leaf.field.replace(".", "_") for leaf in leaves_of(stream)]


def wide_metrics(df: DataFrame, stream: str, keep: Sequence[str] = ()) -> DataFrame:
    """One typed column per declared leaf, named after its path, besides ``keep``.

    The metric kind, or that it is a dimension, is in the column's metadata.
    """
    columns = []
    for leaf, name in zip(leaves_of(stream), wide_columns(stream)):
        column = field_or_null(df, f"databricks.{leaf.field}", leaf.type)
        about = {"dimension": True} if leaf.kind == "dimension" else {"metric_type": leaf.kind or ""}
        columns.append(column.alias(name, metadata=about))
    return df.select(*keep, *columns)


def dimensions_of(df: DataFrame) -> list[str]:
    """Columns of ``df`` that tell series apart: shared dimensions, stream, metric and owner."""
    shared = [name.replace(".", "_") for name in SHARED_DIMENSIONS]
    owner = ["mbean", "application_name", "id", "name"]
    own = ["host", "stream", "field", "attribute", *owner]
    own += [f"{s}_{n}" for s in ("application", "driver", "executor") for n in owner]
    return [c for c in df.columns if c in (*shared, *own)]


def tsds_dedup(
    df: DataFrame,
    dimensions: Sequence[str] | None = None,
    at: str = "ts",
    arrival: str = "arrival",
) -> DataFrame:
    """One row per (dimensions, time), the first to arrive; null dimensions are equal.

    As in ``dedup_terminated``, copies are thinned out before the shuffle.
    """
    if dimensions is None:
        dimensions = dimensions_of(df)
    first = Window.partitionBy(*dimensions, at).orderBy(arrival)
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def normalise_dataset(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Older spelling of the four metric datasets to the one in use."""
    names = "|".join(("application", "node", "executor", "driver"))
    old = OLD_DATASET_PREFIX.replace(".", "[.]")
    return df.withColumn(
        dataset,
        F.regexp_replace(F.col(dataset), f"^{old}({names})$", f"{DATASET_PREFIX}$1"),
    )

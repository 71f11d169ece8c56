"""Node role and node facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.sequences import time_slice, with_previous
from tidewatch.schema.fixed_values import (
    DRIVER_FLAG,
    DRIVER_ROLE,
    EXECUTOR_ROLE,
    NODE_FACTS,
)
from tidewatch.session import land


def node_role(df: DataFrame, flag: str = "is_driver") -> DataFrame:
    """Role by the node's flag: driver only for the exact text, executor for all else."""
    return df.withColumn(
        "node_role",
        F.when(F.col(flag) == DRIVER_FLAG, DRIVER_ROLE).otherwise(EXECUTOR_ROLE),
    )


def add_node_facts(
    df: DataFrame,
    nodes: DataFrame,
    host: str = "host",
    at: str | None = None,
    slice_seconds: int = 86_400,
) -> DataFrame:
    """Stamp role and facts of the row's node; rows of unknown nodes stay, facts null.

    Without ``at`` a host listed several times counts once: with the newest ``seen_at`` if the
    inventory has that column, else with the largest facts in column order.  With ``at``, a time
    column, a row gets the facts its host had then: those seen last at or before that time (of
    several seen at once the largest), none before the first.  Facts without ``seen_at`` hold from
    the beginning.

    The inventory grows with the fleet, so it is not forced into a broadcast: Spark
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` (by estimate, or by
    measured size at run time), and otherwise sorts and merges, splitting a host with
    many rows through AQE's skew join.
    """
    facts = ("node_role", *NODE_FACTS)
    if at is not None:
        return _as_of(df, node_role(nodes), host, at, facts, slice_seconds)
    order = ["seen_at"] if "seen_at" in nodes.columns else []
    inventory = (
        node_role(nodes)
        .groupBy("host")
        .agg(F.max(F.struct(*order, *facts)).alias("_facts"))
        .select("host", *(F.col("_facts")[name].alias(name) for name in facts))
    )
    if host != "host":
        inventory = inventory.withColumnRenamed("host", host)
    return df.join(inventory, host, "left").withColumn(
        "node_role", F.coalesce("node_role", F.lit(EXECUTOR_ROLE))
    )


#: stands before every time
_ALWAYS = "timestamp'0001-01-01 00:00:00+00:00'"


def _as_of(
    df: DataFrame, nodes: DataFrame, host: str, at: str, facts: Sequence[str], slice_seconds: int
) -> DataFrame:
    """Two joins on equal keys instead of one on ranges.

    Time is cut into slices.  Per host and slice the facts seen in it are listed, and per host the
    last facts of each slice; a row takes the last of its own slice up to its time, else the last
    of an earlier slice.  The lists are as long as a slice has changes, and as there are slices.
    """
    seen = F.coalesce("seen_at", F.expr(_ALWAYS)).alias("at")
    listed = nodes.select("host", seen, F.struct(*facts).alias("facts"))
    # Only changes matter; of facts seen at the same time the largest count.
    once = listed.groupBy("host", "at").agg(F.max("facts").alias("facts"))
    before = with_previous(once, ["host"], "at", ["facts"], slice_seconds)
    changes = before.filter("previous_at IS NULL OR previous_facts <> facts").select(
        "host", "at", "facts", time_slice("at", slice_seconds).alias("slice")
    )
    entry = F.struct("at", "facts")
    inside = changes.groupBy("host", "slice").agg(
        F.array_sort(F.collect_list(entry)).alias("_inside"), F.max(entry).alias("last")
    )
    inside = land(inside, "node-changes")
    by_slice = inside.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("slice", F.col("last.facts").alias("facts")))).alias("_earlier")
    )
    own = time_slice(at, slice_seconds)
    rows = (
        df.withColumn("_slice", own)
        .join(_named(inside.drop("last"), host, "_slice"), [host, "_slice"], "left")
        .join(_named(by_slice, host), host, "left")
    )
    fits = F.filter("_inside", lambda e: e["at"] <= F.col(at))
    past = F.filter("_earlier", lambda e: e["slice"] < F.col("_slice"))
    # ``get`` of place -1 of an empty list is null
    found = F.coalesce(F.get(fits, F.size(fits) - 1)["facts"], F.get(past, F.size(past) - 1)["facts"])
    role = F.coalesce(F.col("_found.node_role"), F.lit(EXECUTOR_ROLE))
    return rows.withColumn("_found", found).select(
        *df.columns,
        role.alias("node_role"),
        *(F.col(f"_found.{name}").alias(name) for name in facts if name != "node_role"),
    )


def _named(facts: DataFrame, host: str, slice_: str | None = None) -> DataFrame:
    return facts.withColumnsRenamed({"host": host} | ({"slice": slice_} if slice_ else {}))

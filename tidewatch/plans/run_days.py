"""Distinct runs per day and value as bits: counts that merge without reading runs again.

A day table has one row per time bucket, dimension, value and stretch of 64 run ids, with one bit
for each of the runs.  Bits of several tables, days or batches are merged by OR, so a run seen in
many rows, tables or polls counts once.  Counts are exact.  Runs of a stretch that fall on different
days cost a word each, not a bitmap of some KB that is empty but for one bit.

Run ids are the API's numbers; rows without one are left out.  The run id itself is no dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.durations import bucket_start
from tidewatch.plans.dashboards import CONTROLS, RUN_ID, START, STATE, field

DAY_TABLE = "bucket timestamp, dimension string, value string, stretch bigint, runs bigint"
ALL, RESULT = "all", "result_state"
STRETCH_BITS = 6
_KEYS = ("bucket", "dimension", "value", "stretch")


def run_days(events: DataFrame, every: str = "24h") -> DataFrame:
    """The day table of an event table (or of a part of one)."""
    dimensions = {ALL: F.lit(None), RESULT: field(events, STATE)} | {
        name: field(events, path) for name, path in CONTROLS.items() if path != RUN_ID
    }
    # Plain columns first: below a generator Spark would keep the whole job struct.
    shown = events.select(
        field(events, RUN_ID).try_cast("bigint").alias("_run"),
        bucket_start(field(events, START), every).alias("bucket"),
        *(column.cast("string").alias(f"_{name}") for name, column in dimensions.items()),
    ).filter("_run IS NOT NULL")
    values = F.array(
        *(F.struct(F.lit(n).alias("dimension"), F.col(f"_{n}").alias("value")) for n in dimensions)
    )
    return (
        shown.select("_run", "bucket", F.inline(values))
        .groupBy("bucket", "dimension", "value", F.shiftright("_run", STRETCH_BITS).alias("stretch"))
        .agg(F.bit_or(_bit("_run")).alias("runs"))
    )


def _bit(run: str) -> Column:
    place = F.col(run).bitwiseAND(F.lit((1 << STRETCH_BITS) - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def merge_days(days: DataFrame) -> DataFrame:
    """One row per key of day tables put together."""
    return days.groupBy(*_KEYS).agg(F.bit_or("runs").alias("runs"))


def _counted(days: DataFrame, *keys: str | Column) -> DataFrame:
    merged = days.groupBy(*keys, "stretch").agg(F.bit_or("runs").alias("runs"))
    names = merged.columns[:-2]
    return merged.groupBy(*names).agg(F.sum(F.bit_count("runs").cast("bigint")).alias("n_runs"))


def totals_of_days(days: DataFrame) -> DataFrame:
    """As ``run_totals``."""
    counts = _counted(days.filter(F.col("dimension").isin(ALL, RESULT)), "dimension", "value")

    def of(dimension: str, value: str | None = None) -> Column:
        fits = (F.col("dimension") == dimension) & F.col("value").eqNullSafe(F.lit(value))
        return F.coalesce(F.sum(F.when(fits, F.col("n_runs"))), F.lit(0).cast("bigint"))

    return counts.agg(
        of(ALL).alias("total_runs"),
        of(RESULT, "SUCCESS").alias("success_runs"),
        of(RESULT, "FAILED").alias("failed_runs"),
        of(RESULT, "CANCELED").alias("canceled_runs"),
    )


def timeline_of_days(days: DataFrame, every: str = "24h") -> DataFrame:
    """As ``runs_timeline``, in buckets as wide as the table's or a multiple of it."""
    placed = days.filter((F.col("dimension") == RESULT) & F.col("bucket").isNotNull())
    counts = _counted(
        placed, bucket_start(F.col("bucket"), every).alias("bucket"), F.col("value").alias("result_state")
    )
    return counts.select("bucket", "result_state", "n_runs")


def options_of_days(days: DataFrame) -> DataFrame:
    """As ``control_options``, without the run id."""
    shown = days.filter(~F.col("dimension").isin(ALL, RESULT) & F.col("value").isNotNull())
    return _counted(shown, F.col("dimension").alias("control"), "value")

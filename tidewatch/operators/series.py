"""Time-series steps over metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.durations import parse_duration, spark_interval
from tidewatch.operators.sequences import with_previous
from tidewatch.schema.fixed_values import SAMPLE_PERIOD
from tidewatch.schema.metric_leaves import mapped_leaves

SERIES = ("host", "mbean", "stream", "field")


def sampled_kind(field: str | Column = "field") -> Column:
    """Kind told by the bean type: a few declared counters are sampled as gauges."""
    field = F.col(field) if isinstance(field, str) else field
    counters = [leaf.field for leaf in mapped_leaves() if leaf.attribute == "Count"]
    return F.when(field.isin(counters), "counter").otherwise("gauge")


def of_kind(
    matched: DataFrame, kind: str, override_kind: str | Column | None = None
) -> DataFrame:
    """Matched samples of one metric kind; ``override_kind`` replaces the declared kind."""
    if override_kind is None:
        override_kind = F.col("kind")
    elif isinstance(override_kind, str):
        override_kind = F.lit(override_kind)
    return matched.filter(override_kind == kind)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / F.lit(1e6)


def counter_rate(
    df: DataFrame,
    dims: Sequence[str] = SERIES,
    at: str = "ts",
    value: str = "value",
    slice_seconds: int = 3600,
) -> DataFrame:
    """Add ``delta`` and ``rate`` (per second) against the sample before, per series.

    A lower value means the counter started over, so the whole value is new.  The first
    sample of a series has neither.
    """
    before = F.col(f"previous_{value}")
    joined = with_previous(df, dims, at, [value], slice_seconds)
    grown = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    passed = seconds_between(F.col(f"previous_{at}"), F.col(at))
    return (
        joined.withColumn("delta", F.when(before.isNotNull(), grown))
        .withColumn("rate", F.try_divide("delta", passed))
        .drop(f"previous_{value}", f"previous_{at}")
    )


def gauge_rollup(
    df: DataFrame,
    dims: Sequence[str] = SERIES,
    every: str = SAMPLE_PERIOD,
    at: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Min, max, average, last and count of a gauge per series and ``every`` bucket."""
    return (
        df.groupBy(*dims, F.window(at, spark_interval(every)).alias("_bucket"))
        .agg(
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            (F.sum(value) / F.count(value)).alias("avg_value"),
            F.max_by(value, at).alias("last_value"),
            F.count(value).alias("n_samples"),
        )
        .select(
            F.col("_bucket.start").alias("bucket"),
            *dims,
            "min_value",
            "max_value",
            "avg_value",
            "last_value",
            "n_samples",
        )
    )


def sample_gaps(
    df: DataFrame,
    dims: Sequence[str] = SERIES,
    period: str = SAMPLE_PERIOD,
    at: str = "ts",
    slice_seconds: int = 3600,
) -> DataFrame:
    """Stretches between neighbouring samples of a series that exceed the sample period."""
    narrow = df.select(*dims, at)
    paired = with_previous(narrow, dims, at, [], slice_seconds)
    spent = seconds_between(F.col(f"previous_{at}"), F.col(at))
    return paired.filter(spent > parse_duration(period) / 1000).select(
        *dims,
        F.col(f"previous_{at}").alias("gap_start"),
        F.col(at).alias("gap_end"),
        spent.alias("gap_seconds"),
    )

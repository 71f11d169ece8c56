"""Gauge rollups of rollups: partial results that merge from minutes to hours to days.

A partial holds what all coarser results need: least, greatest, sum, number, and the last value with
its time.  Partials of one bucket, of different batches or of finer buckets, merge by the same
operation, so coarser levels are made from finer ones and never from samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.durations import bucket_start, parse_duration
from tidewatch.operators.series import SERIES
from tidewatch.sinks.batch_tables import BatchTables

_PARTIAL = (
    "bucket timestamp, {dims}, min_value double, max_value double, sum_value double, "
    "n_samples bigint, last struct<at: timestamp, value: double>"
)


def gauge_partials(
    df: DataFrame, every: str, dims: Sequence[str] = SERIES, at: str = "ts", value: str = "value"
) -> DataFrame:
    """Partials of samples per series and ``every`` bucket; samples without a time are left out."""
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
    return (
        df.filter(F.col(at).isNotNull())
        .groupBy(bucket_start(F.col(at), every).alias("bucket"), *dims)
        .agg(
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.sum(value).alias("sum_value"),
            F.count(value).alias("n_samples"),
            last.alias("last"),
        )
    )


def merge_partials(
    partials: DataFrame, every: str | None = None, dims: Sequence[str] = SERIES
) -> DataFrame:
    """Partials put together per bucket, in buckets ``every`` wide if given."""
    bucket = F.col("bucket") if every is None else bucket_start(F.col("bucket"), every)
    return partials.groupBy(bucket.alias("bucket"), *dims).agg(
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("sum_value").alias("sum_value"),
        F.sum("n_samples").alias("n_samples"),
        F.max("last").alias("last"),
    )


def rollup_of_partials(partials: DataFrame, dims: Sequence[str] = SERIES) -> DataFrame:
    """The columns of ``gauge_rollup``."""
    return partials.select(
        "bucket",
        *dims,
        "min_value",
        "max_value",
        F.try_divide("sum_value", "n_samples").alias("avg_value"),
        F.col("last.value").alias("last_value"),
        "n_samples",
    )


class RollupLevels:
    """Partials of several widths, refreshed batch by batch; each width a multiple of the one before.

    A batch adds its own partials: the finest from its samples, each coarser level from the finer.
    Readers merge what batches have added; ``fold`` does so for good.  Samples come once (see
    ``GaugeRollups`` for copies); how late they come does not matter.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        widths: Sequence[str] = ("1m", "1h", "24h"),
        dims: Sequence[str] = SERIES,
    ):
        ms = [parse_duration(width) for width in widths]
        if any(wide % fine for fine, wide in zip(ms, ms[1:])):
            raise ValueError("each width has to be a multiple of the one before")
        self.tables, self.widths, self.dims = BatchTables(spark, root), tuple(widths), tuple(dims)
        self.schema = _PARTIAL.format(dims=", ".join(f"`{name}` string" for name in dims))

    def apply(self, gauges: DataFrame, batch: int) -> bool:
        """Add a batch of gauge samples; false if it has been here before."""
        tables = self.tables.within(gauges.sparkSession)

        def add() -> None:
            finest, *wider = self.widths
            level = tables.write(finest, batch, gauge_partials(gauges, finest, self.dims))
            for width in wider:
                level = tables.write(width, batch, merge_partials(level, width, self.dims))

        return tables.once(batch, add)

    def partials(self, width: str) -> DataFrame:
        return merge_partials(self.tables.read(width, self.schema), dims=self.dims)

    def rollup(self, width: str) -> DataFrame:
        """As ``gauge_rollup`` of all samples so far."""
        return rollup_of_partials(self.partials(width), self.dims)

    def fold(self) -> None:
        """Keep one row per series and bucket for the batches so far."""
        for width in self.widths:
            self.tables.fold(width, self.schema, lambda rows: merge_partials(rows, dims=self.dims))

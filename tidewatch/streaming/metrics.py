"""JMX samples as a stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.durations import bucket_start, parse_duration
from tidewatch.operators.metrics import match_catalogue
from tidewatch.operators.series import SERIES, gauge_rollup, of_kind
from tidewatch.schema.fixed_values import SAMPLE_PERIOD
from tidewatch.sinks.batch_tables import FOLDER, BatchTables

#: what tells a reading apart from all others; copies share it
READING = ("ts", "host", "mbean", "attribute")
#: so many time slices are read by name, with more all are read
SLICES = 1000


def _first() -> Column:
    return F.min(F.struct("arrival", "value"))


def rollup_once(
    samples: DataFrame,
    every: str = SAMPLE_PERIOD,
    dims: Sequence[str] = SERIES,
    streams: Sequence[str] | None = None,
) -> DataFrame:
    """Gauge rollup of landed samples without their copies.

    Copies of a reading are folded by an aggregation, which begins before the shuffle, so
    many copies of one do not meet in one task; the first to arrive counts.
    """
    once = samples.groupBy(*READING).agg(_first().alias("_first"))
    once = once.select(*READING, "_first.value")
    gauges = of_kind(match_catalogue(once, streams), "gauge")
    return gauge_rollup(gauges, dims, every)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


class GaugeRollups:
    """``rollup_once`` kept up to date batch by batch, however late samples come.

    Readings are stored once, by time slice.  A batch is folded, compared with the readings
    stored in its slices, and adds those that are new (or arrived earlier than the copy that is
    stored).  Buckets that got any are rolled up again from their readings, and of a bucket's
    versions the last batch's counts.  No watermark takes part and nothing is closed.
    """

    SAMPLES = (
        "ts timestamp, host string, mbean string, attribute string, "
        f"first struct<arrival: int, value: double>, {FOLDER} int"
    )

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        every: str = SAMPLE_PERIOD,
        dims: Sequence[str] = SERIES,
        streams: Sequence[str] | None = None,
    ):
        self.tables, self.every, self.dims, self.streams = (
            BatchTables(spark, root), every, tuple(dims), streams,
        )
        width = parse_duration(every)
        self.slice_ms = width * -(-86_400_000 // width)

    def apply(self, samples: DataFrame, batch: int) -> bool:
        """Take in a batch of samples; false if it has been here before."""
        tables = self.tables.within(samples.sparkSession)

        def change() -> None:
            slice_ = F.floor(F.unix_millis("ts") / self.slice_ms).cast("int")
            once = samples.filter("ts IS NOT NULL").groupBy(*READING).agg(_first().alias("first"))
            arrived = tables.write("arrived", batch, once.withColumn(FOLDER, slice_))
            touched = [r[0] for r in arrived.select(FOLDER).distinct().limit(SLICES + 1).collect()]
            stored = tables.read("samples", self.SAMPLES, touched if len(touched) <= SLICES else None)
            kept = stored.groupBy(*READING, FOLDER).agg(F.min("first").alias("first"))
            fresh = (
                arrived.join(kept.withColumnRenamed("first", "held"), _same(arrived, kept, READING), "left")
                .filter("held IS NULL OR first < held")
                .select(*(arrived[c] for c in READING), "first", arrived[FOLDER])
            )
            fresh = tables.write("samples", batch, fresh, by=[FOLDER])
            columns = (*READING, "first")
            bucket = bucket_start(F.col("ts"), self.every)
            placed = kept.select(*columns).unionByName(fresh.select(*columns)).withColumn("_bucket", bucket)
            changed = fresh.select("host", "mbean", bucket.alias("_bucket")).distinct()
            again = placed.join(changed, _same(placed, changed, ("host", "mbean", "_bucket")), "left_semi")
            readings = again.select(*READING, F.col("first.arrival"), F.col("first.value"))
            tables.write("rollup", batch, rollup_once(readings, self.every, self.dims, self.streams))

        return tables.once(batch, change)

    def samples(self) -> DataFrame:
        """Every reading so far once."""
        once = self.tables.read("samples", self.SAMPLES).groupBy(*READING).agg(F.min("first").alias("first"))
        return once.select(*READING, "first.arrival", "first.value")

    def rollup(self) -> DataFrame:
        """Rows as ``rollup_once`` gives for all samples so far."""
        dims = ", ".join(f"`{name}` string" for name in self.dims)
        numbers = "min_value double, max_value double, avg_value double, last_value double"
        rows = self.tables.read("rollup", f"bucket timestamp, {dims}, {numbers}, n_samples bigint")
        keys = ("bucket", *self.dims)
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
        return last.select(*keys, "_last.*")

"""Job-run pages as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.durations import bucket_start, positive_ms_to_timestamp
from tidewatch.operators.job_runs import dedup_terminated, split_runs
from tidewatch.plans.job_events import current_rows, run_task_rows, shape_events
from tidewatch.schema.fixed_values import LOOKBACK, REQUEST_INTERVAL, TERMINATED
from tidewatch.sinks.batch_tables import FOLDER, BatchTables, folder_of


class JobEventFeed:
    """Events of pages as they come in batches, each terminated run and task once.

    Keys of emitted runs are kept by hash folder, for good, so neither the order nor the age of
    polls matters, and the same feed serves a stream (``run_batches``) and jobs that run on
    different days.  A batch's pages are parsed once: their run/task rows are stored, and looked
    up, shaped and recorded from there.  Rows of open runs and rows without an id always pass.
    Within a batch the first poll wins (``dedup_terminated``).
    """

    SEEN = f"run bigint, task bigint, {FOLDER} int"

    def __init__(self, spark: SparkSession, root: str):
        self.tables = BatchTables(spark, root)

    def apply(
        self,
        pages: DataFrame,
        batch: int,
        now: datetime | Column,
        host: str | Column,
        request_interval: str = REQUEST_INTERVAL,
        lookback: str = LOOKBACK,
        poll: str = "poll",
        **shape,
    ) -> bool:
        """Store a batch's events; false if the batch has been here before."""
        tables = self.tables.within(pages.sparkSession)

        def emit() -> None:
            rows = current_rows(run_task_rows(pages, now, lookback), now, request_interval)
            run = F.coalesce("job.job_run_id", "job.run_id")
            ended = F.coalesce(F.col("job.status.state") == TERMINATED, F.lit(False))
            once = dedup_terminated(rows, poll=poll).withColumns(
                {
                    "_run": F.when(ended, run),
                    "_task": F.when(ended, F.col("job.tasks.run_id")),
                    FOLDER: folder_of("_run"),
                }
            )
            arrived = tables.write("arrived", batch, once)
            keys = arrived.filter("_run IS NOT NULL").select(
                F.col("_run").alias("run"), F.col("_task").alias("task"), FOLDER
            )
            touched = [row[0] for row in keys.select(FOLDER).distinct().collect()]
            seen = tables.read("seen", self.SEEN, touched)
            same = (F.col("run") == F.col("_run")) & F.col("task").eqNullSafe(F.col("_task"))
            # Rows without a key can match none.  In the join they would all meet in one task.
            keyed = arrived.filter("_run IS NOT NULL")
            fresh = keyed.join(seen.select("run", "task"), same, "left_anti").unionByName(
                arrived.filter("_run IS NULL")
            )
            shaped = shape_events(fresh.drop("_run", "_task", FOLDER), now, host, **shape)
            tables.write("events", batch, shaped)
            known = (keys["run"] == seen["run"]) & keys["task"].eqNullSafe(seen["task"])
            tables.write("seen", batch, keys.join(seen, known, "left_anti"), by=[FOLDER])

        return tables.once(batch, emit)

    def events(self, schema: T.StructType) -> DataFrame:
        """All events so far; ``schema`` is that of ``job_events``."""
        return self.tables.read("events", schema).drop("batch")

    def fold(self) -> None:
        """Gather the keys of all batches, so that fewer files are read for each."""
        self.tables.fold("seen", self.SEEN, lambda rows: rows.repartition(FOLDER), by=[FOLDER])


def _started_runs(pages: DataFrame, *columns: str) -> DataFrame:
    return split_runs(pages).select(
        F.coalesce("job_run_id", "run_id").alias("run"),
        F.col("state.result_state").alias("result_state"),
        F.coalesce(F.col("status.state") == TERMINATED, F.lit(False)).alias("ended"),
        positive_ms_to_timestamp(F.col("start_time")).alias("started"),
        *columns,
    )


def status_counts(pages: DataFrame, every: str = "24h", order: str = "poll") -> DataFrame:
    """Runs per start bucket and latest result state, of landed pages; ``order`` tells polls apart."""
    runs = _started_runs(pages, order).filter("run IS NOT NULL")
    latest = runs.groupBy("run").agg(
        F.max(F.struct(order, "ended", "started", "result_state")).alias("latest")
    )
    return (
        latest.filter("latest.started IS NOT NULL")
        .groupBy(
            bucket_start(F.col("latest.started"), every).alias("bucket"),
            F.col("latest.result_state").alias("result_state"),
        )
        .agg(F.count("*").alias("n_runs"))
    )


class StatusCounts:
    """``status_counts`` kept up to date batch by batch, whatever arrives late or changes.

    The last state of each run is kept by hash folder.  A batch's runs are folded to one row
    each, compared with what is kept for them, and those that changed give signed deltas: one
    less where the run was counted, one more where it counts now.  Counts are the sums of deltas;
    neither a watermark nor a closing step takes part, so a wrong date harms its own run only,
    and only until a later poll corrects it.  An older poll that arrives later changes nothing.
    """

    STATE = "at: bigint, ended: boolean, started: timestamp, result_state: string"
    STATES = f"run bigint, state struct<{STATE}>, before struct<{STATE}>, {FOLDER} int"
    DELTAS = "bucket timestamp, result_state string, n_runs bigint"

    def __init__(self, spark: SparkSession, root: str, every: str = "24h", order: str = "poll"):
        self.tables, self.every, self.order = BatchTables(spark, root), every, order

    def apply(self, pages: DataFrame, batch: int) -> bool:
        """Take in a batch of pages; false if it has been here before."""
        tables = self.tables.within(pages.sparkSession)

        def change() -> None:
            at = F.col(self.order)
            if isinstance(pages.schema[self.order].dataType, T.TimestampType):
                at = F.unix_micros(at)
            state = F.struct(at.cast("bigint").alias("at"), "ended", "started", "result_state")
            latest = (
                _started_runs(pages, self.order)
                .filter("run IS NOT NULL")
                .groupBy("run")
                .agg(F.max(state).alias("state"))
            )
            arrived = tables.write("arrived", batch, latest.withColumn(FOLDER, folder_of("run")))
            touched = [row[0] for row in arrived.select(FOLDER).distinct().collect()]
            kept = (
                tables.read("states", self.STATES, touched)
                .join(arrived.select("run"), "run", "left_semi")
                .groupBy("run")
                .agg(F.max("state").alias("before"))
            )
            changed = (
                arrived.join(kept, "run", "left")
                .filter("before IS NULL OR state > before")
                .select("run", "state", "before", FOLDER)
            )
            stored = tables.write("states", batch, changed, by=[FOLDER])
            signed = F.array(
                F.struct(F.col("before").alias("s"), F.lit(-1).cast("bigint").alias("n")),
                F.struct(F.col("state").alias("s"), F.lit(1).cast("bigint").alias("n")),
            )
            deltas = (
                stored.select(F.inline(signed))
                .filter("s.started IS NOT NULL")
                .groupBy(
                    bucket_start(F.col("s.started"), self.every).alias("bucket"), "s.result_state"
                )
                .agg(F.sum("n").alias("n_runs"))
                .filter("n_runs <> 0")
            )
            tables.write("deltas", batch, deltas)

        return tables.once(batch, change)

    def counts(self) -> DataFrame:
        """``bucket, result_state, n_runs`` as of the last batch."""
        return _summed(self.tables.read("deltas", self.DELTAS))

    def fold(self) -> None:
        """Keep one row per run and per count for the batches so far."""

        def last(rows: DataFrame) -> DataFrame:
            best = rows.groupBy(FOLDER, "run").agg(F.max(F.struct("state", "before")).alias("s"))
            return best.select("run", "s.state", "s.before", FOLDER)

        self.tables.fold("states", self.STATES, last, by=[FOLDER])
        self.tables.fold("deltas", self.DELTAS, _summed)


def _summed(deltas: DataFrame) -> DataFrame:
    sums = deltas.groupBy("bucket", "result_state").agg(F.sum("n_runs").alias("n_runs"))
    return sums.filter("n_runs <> 0")

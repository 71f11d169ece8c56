"""Questions the job-run dashboard asks of the event table.

Events have one row per run and task, so counts of runs are counts of distinct run ids.
The event table may be nested, as stored, or have its leaves as plain columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.durations import pretty_duration, spark_interval

RUN_ID = "job.job_run_id"
STATE = "job.state.result_state"
START = "job.start_time"

CONTROLS = {
    "job_name": "job.run_name",
    "job_id": "job.job_id",
    "job_run_id": RUN_ID,
    "cluster_id": "databricks.cluster_id",
}


def field(events: DataFrame, path: str) -> Column:
    """The event field at ``path``, wherever the table keeps it."""
    plain = path.replace(".", "_")
    return F.col(plain) if plain in events.columns else F.col(path)


def run_totals(events: DataFrame) -> DataFrame:
    """Total, successful, failed and canceled runs, in one row.

    Runs are folded first, with partial aggregation, instead of four distinct counts
    that would multiply the rows.
    """
    shown = {"success": "SUCCESS", "failed": "FAILED", "canceled": "CANCELED"}
    runs = (
        events.filter(field(events, RUN_ID).isNotNull())
        .groupBy(field(events, RUN_ID).alias("run"))
        .agg(
            *(
                F.max(F.coalesce(field(events, STATE) == state, F.lit(False))).alias(name)
                for name, state in shown.items()
            )
        )
    )
    return runs.agg(
        F.count("*").alias("total_runs"),
        *(F.count_if(F.col(name)).alias(f"{name}_runs") for name in shown),
    )


def runs_timeline(events: DataFrame, every: str = "24h") -> DataFrame:
    """Runs per time bucket of their start and result state (null: still going)."""
    return (
        events.groupBy(
            F.window(field(events, START), spark_interval(every)).alias("_bucket"),
            field(events, STATE).alias("result_state"),
        )
        .agg(F.count_distinct(field(events, RUN_ID)).alias("n_runs"))
        .select(F.col("_bucket.start").alias("bucket"), "result_state", "n_runs")
    )


def run_detail(events: DataFrame) -> DataFrame:
    """Columns of the detail table."""
    return events.select(
        field(events, RUN_ID).alias("job_run_id"),
        field(events, "job.tasks.run_id").alias("task_run_id"),
        field(events, "job.run_name").alias("run_name"),
        field(events, "job.job_id").alias("job_id"),
        field(events, STATE).alias("result_state"),
        field(events, START).alias("start_time"),
        field(events, "job.end_time").alias("end_time"),
        field(events, "job.run_duration").alias("run_duration"),
        field(events, "job.creator_user_name").alias("creator_user_name"),
        field(events, "databricks.cluster_id").alias("cluster_id"),
        field(events, "job.status.termination_details.code").alias("termination_code"),
    )


def run_detail_table(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The detail table, latest rows first; with ``limit`` only so many."""
    latest = (
        run_detail(events)
        .orderBy(
            F.col("start_time").desc_nulls_last(),
            F.col("job_run_id").asc(),
            F.col("task_run_id").asc_nulls_first(),
        )
    )
    return latest if limit is None else latest.limit(limit)


def with_pretty_duration(detail: DataFrame, ms: str = "run_duration") -> DataFrame:
    return detail.withColumn("duration", pretty_duration(F.col(ms)))


def control_filter(events: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """Events matching every control that has choices; a control without any filters nothing.

    Besides the controls, any event field may be named by its path, as a click on a
    chart or table cell does.
    """
    for control, values in choices.items():
        if values:
            events = events.filter(field(events, CONTROLS.get(control, control)).isin(list(values)))
    return events


def control_options(events: DataFrame) -> DataFrame:
    """Values of each control with the runs behind them.

    One pass: each row yields its four options, and repeated (option, run) pairs are
    folded before the shuffle.
    """
    # Plain columns first: below a generator Spark would keep the whole job struct.
    shown = events.select(
        field(events, RUN_ID).alias("_run"),
        *(field(events, path).cast("string").alias(name) for name, path in CONTROLS.items()),
    )
    options = F.array(
        *(F.struct(F.lit(name).alias("control"), F.col(name).alias("value")) for name in CONTROLS)
    )
    return (
        shown.select("_run", F.inline(options))
        .filter(F.col("value").isNotNull())
        .groupBy("control", "value")
        .agg(F.count_distinct("_run").alias("n_runs"))
    )


def _utc(moment: datetime) -> Column:
    return F.lit(moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc))


def time_range(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Events of runs that started in ``[start, end)``."""
    return events.filter((field(events, START) >= _utc(start)) & (field(events, START) < _utc(end)))


def run_trend(events: DataFrame, days: int = 7) -> DataFrame:
    """Runs per day and their mean over the last ``days`` days that had any.

    The window without keys runs over one row per calendar day, not over the events.
    """
    daily = (
        events.filter(field(events, START).isNotNull())
        .groupBy(F.to_date(field(events, START)).alias("day"))
        .agg(F.count_distinct(field(events, RUN_ID)).alias("n_runs"))
    )
    recent = Window.orderBy("day").rowsBetween(1 - days, Window.currentRow)
    mean = F.sum("n_runs").over(recent) / F.count("n_runs").over(recent)
    return daily.withColumn("moving_average", mean)


def failed_job_alert(
    events: DataFrame, at_least: int = 3, every: str = "24h"
) -> DataFrame:
    """Jobs with at least so many failed runs in a time bucket."""
    return (
        events.filter(field(events, STATE) == "FAILED")
        .groupBy(
            field(events, "job.job_id").alias("job_id"),
            F.window(field(events, START), spark_interval(every)).alias("_bucket"),
        )
        .agg(F.count_distinct(field(events, RUN_ID)).alias("failed_runs"))
        .filter(F.col("failed_runs") >= at_least)
        .select("job_id", F.col("_bucket.start").alias("bucket"), "failed_runs")
    )

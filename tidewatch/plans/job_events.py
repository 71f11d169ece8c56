"""The job-run event table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.durations import as_time
from tidewatch.operators import job_runs as steps
from tidewatch.schema.fixed_values import LOOKBACK, REQUEST_INTERVAL
from tidewatch.sources.run_pages import lookback_filter


def run_task_rows(pages: DataFrame, now: datetime | Column, lookback: str = LOOKBACK) -> DataFrame:
    """Run/task rows of the pages within the lookback, the run in ``job``."""
    runs = lookback_filter(steps.split_runs(pages), now, lookback)
    return steps.as_job(steps.split_tasks(runs))


def current_rows(
    rows: DataFrame, now: datetime | Column, request_interval: str = REQUEST_INTERVAL
) -> DataFrame:
    """Rows still worth an event at this poll."""
    return steps.drop_stale(steps.flag_in_interval(rows, now, request_interval))


def shape_events(
    rows: DataFrame,
    now: datetime | Column,
    host: str | Column,
    tags: Sequence[str] = (),
    preserve_original: bool = False,
    namespace: str = "default",
    nested: bool = True,
) -> DataFrame:
    """Event columns and declared types for run/task rows; narrow throughout.

    Without ``nested`` the leaves are plain columns (``job_run_name``), which lets a query
    on events that are not stored read only the source columns it needs.
    """
    if "error_message" not in rows.columns:
        rows = rows.withColumn("error_message", F.lit(None).cast("string"))
    if "decode_error" in rows.columns:
        rows = steps.capture_error(rows, "decode_error")
    events = (
        rows.withColumn("@timestamp", as_time(now))
        .transform(steps.drop_message)
        .transform(steps.cloud_provider, host)
        .transform(steps.with_run_times)
        .transform(steps.stamp_stream, namespace=namespace)
        .transform(steps.apply_tags, tags, preserve_original)
        .transform(steps.cluster_id)
        .transform(steps.ecs_constants)
        .transform(steps.event_times, "run_start", "run_end")
        .transform(steps.event_duration, "run_ms")
        .transform(steps.outcome)
        .transform(steps.related_user)
        .transform(steps.documented_ids)
        .transform(steps.drop_transient)
    )
    keep = ["ecs_version", "tags", "error_message"]
    if "event_original" in events.columns:
        events = steps.retain_original(events)
        keep.append("event_original")
    return steps.enforce_job_schema(events, keep, nested)


def job_events(
    pages: DataFrame,
    now: datetime | Column,
    host: str | Column,
    request_interval: str = REQUEST_INTERVAL,
    lookback: str = LOOKBACK,
    poll: str | None = "poll",
    counted: bool = False,
    **shape,
) -> DataFrame:
    """Events of landed pages: one row per run and task.

    Duplicates go before the event columns are added, so only the run itself is
    shuffled.  ``poll`` names the column ordering repeated polls; ``None`` when the
    pages come from a single one.  ``now`` is a time, or the column that says when a page
    was fetched, so that pages of several polls are each judged by their own.  ``counted`` is that
    of ``dedup_terminated``.
    """
    rows = current_rows(run_task_rows(pages, now, lookback), now, request_interval)
    if poll is not None:
        rows = steps.dedup_terminated(rows, poll=poll, counted=counted)
    return shape_events(rows, now, host, **shape)


def job_events_from_text(
    messages: DataFrame,
    now: datetime | Column,
    host: str | Column,
    request_interval: str = REQUEST_INTERVAL,
    poll: str | None = "poll",
    **shape,
) -> DataFrame:
    """Events of run/task records shipped as JSON text in ``message``.

    A text that cannot be read stays as a row with ``error_message``.
    """
    rows = steps.decode_json(messages.withColumn("event_original", F.col("message")))
    rows = current_rows(rows, now, request_interval)
    if poll is not None:
        rows = steps.dedup_terminated(rows, poll=poll)
    return shape_events(rows, now, host, **shape)

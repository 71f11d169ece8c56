"""Declared leaves of the job-run event table.

Fixed values: field paths, types and units below must be exactly these.  One leaf per
line: ``path  type  unit`` (``-`` means no unit).
"""

from __future__ import annotations

from typing import NamedTuple


class JobLeaf(NamedTuple):
    path: str
    type: str
    unit: str | None


# Fixed values.
_LEAVES = """
    data_stream.type  string  -
    data_stream.dataset  string  -
    data_stream.namespace  string  -
    @timestamp  timestamp  -
    job.job_id  string  -
    job.job_run_id  string  -
    job.run_id  string  -
    job.original_attempt_run_id  string  -
    job.run_number  bigint  -
    job.number_in_job  string  -
    job.run_name  string  -
    job.run_page_url  string  -
    job.run_type  string  -
    job.run_duration  bigint  ms
    job.start_time  timestamp  -
    job.end_time  timestamp  -
    job.setup_duration  bigint  ms
    job.execution_duration  bigint  ms
    job.cleanup_duration  bigint  ms
    job.queue_duration  bigint  ms
    job.creator_user_name  string  -
    job.state.life_cycle_state  string  -
    job.state.result_state  string  -
    job.state.state_message  string  -
    job.state.user_cancelled_or_timedout  boolean  -
    job.status.state  string  -
    job.status.termination_details.code  string  -
    job.status.termination_details.type  string  -
    job.tasks.run_id  string  -
    job.tasks.start_time  timestamp  -
    job.tasks.end_time  timestamp  -
    job.tasks.setup_duration  bigint  ms
    job.tasks.execution_duration  bigint  ms
    job.tasks.cleanup_duration  bigint  ms
    job.tasks.queue_duration  bigint  ms
    job.task.run_id  string  -
    job.task.task_key  string  -
    job.task.description  string  -
    job.task.state.life_cycle_state  string  -
    job.task.state.result_state  string  -
    job.task.start_time  timestamp  -
    job.task.end_time  timestamp  -
    job.task.execution_duration  bigint  -
    job.trigger  string  -
    job.schedule.quartz_cron_expression  string  -
    job.schedule.timezone_id  string  -
    job.schedule.pause_status  string  -
    databricks.cluster_id  string  -
    databricks.cluster_name  string  -
    databricks.workspace_id  string  -
    databricks.node_role  string  -
    databricks.container_ip  string  -
    databricks.instance_type  string  -
    databricks.is_job_cluster  string  -
    event.id  string  -
    event.kind  string  -
    event.type  array<string>  -
    event.category  array<string>  -
    event.module  string  -
    event.dataset  string  -
    event.start  timestamp  -
    event.end  timestamp  -
    event.duration  bigint  nanos
    event.outcome  string  -
    user.name  string  -
    cloud.provider  string  -
    related.user  array<string>  -
"""

JOB_LEAVES = tuple(
    JobLeaf(path, type_, None if unit == "-" else unit)
    for path, type_, unit in (line.split() for line in _LEAVES.strip().splitlines())
)

"""Types of landed source records."""

from __future__ import annotations

_CLUSTER = "struct<cluster_id: string>"

_TASK = {
    "run_id": "bigint",
    "start_time": "bigint",
    "end_time": "bigint",
    "setup_duration": "bigint",
    "execution_duration": "bigint",
    "cleanup_duration": "bigint",
    "queue_duration": "bigint",
    "cluster_instance": _CLUSTER,
}

_RUN = {
    "job_id": "bigint",
    "job_run_id": "bigint",
    "run_id": "bigint",
    "original_attempt_run_id": "bigint",
    "run_number": "bigint",
    "number_in_job": "bigint",
    "run_name": "string",
    "run_page_url": "string",
    "run_type": "string",
    "run_duration": "bigint",
    "start_time": "bigint",
    "end_time": "bigint",
    "setup_duration": "bigint",
    "execution_duration": "bigint",
    "cleanup_duration": "bigint",
    "queue_duration": "bigint",
    "creator_user_name": "string",
    "trigger": "string",
    "state": "struct<life_cycle_state: string, result_state: string, state_message: string, "
    "user_cancelled_or_timedout: boolean>",
    "status": "struct<state: string, "
    "termination_details: struct<code: string, type: string>>",
    "schedule": "struct<quartz_cron_expression: string, timezone_id: string, "
    "pause_status: string>",
    "cluster_instance": _CLUSTER,
}

RUN_FIELDS = (*_RUN, "tasks")


def struct_of(columns: dict[str, str]) -> str:
    """``{"a": "int"}`` as ``struct<`a`: int>``."""
    return "struct<" + ", ".join(f"`{name}`: {type_}" for name, type_ in columns.items()) + ">"


# One run as the API lists it (many tasks), and one run/task row after the split (one task).
LISTED_RUN = struct_of({**_RUN, "tasks": f"array<{struct_of(_TASK)}>"})
RUN_TASK = struct_of({**_RUN, "tasks": struct_of(_TASK)})

RUN_PAGE = f"page_token string, next_page_token string, runs array<{LISTED_RUN}>"

# Text of a record that could not be read as declared.
CORRUPT = "_corrupt_record"

JMX_SAMPLE = (
    "ts timestamp, arrival int, host string, mbean string, attribute string, "
    "value double, status string"
)

SYSTEM_METRIC = "ts timestamp, host string, metricset string, metrics map<string, double>"

LOG_LINE = "file string, block bigint, pos bigint, value string"

NODE = (
    "host string, is_driver string, cluster_id string, container_ip string, "
    "instance_type string, cluster_name string, is_job_cluster string"
)

"""The questions of ``queries`` in plain SQL over the given tables."""

from __future__ import annotations

from tidewatch.schema.fixed_values import METRIC_SETS
from tidewatch.schema.metric_leaves import leaves_of, mapped_leaves

NO_LIMIT = 10**12
NOW_US = 996_710_400_000_000  # 2001-08-02T00:00:00Z
HOUR_MS = 3_600_000
POLL_GAP_MS = 720 * HOUR_MS
INTERVAL_MS = NOW_US // 1000 - 8760 * HOUR_MS
LOOKBACK_MS = NOW_US // 1000 - 43800 * HOUR_MS

RUNS = """
items AS (
    SELECT l_orderkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
        row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS i
    FROM lineitem),
loads AS (
    SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS total, count(*) AS n_tasks
    FROM items GROUP BY l_orderkey),
runs AS (
    SELECT o_orderkey AS job_run_id, o_custkey AS job_id,
        o_orderkey % 1000 AS run_number,
        'job_' || (o_custkey % 20) AS run_name,
        'https://x/#job/' || o_custkey || '/run/' || o_orderkey AS run_page_url,
        o_orderkey % 7 * 1000 AS api_duration,
        epoch_ms(o_orderdate) AS start_time,
        CASE WHEN o_orderstatus = 'P' THEN 0
            WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE epoch_ms(o_orderdate) + 60000 * coalesce(total, 1) END AS end_time,
        o_custkey % 5 * 1000 AS setup_duration,
        60000 * coalesce(total, 1) AS execution_duration,
        o_orderkey % 3 * 100 AS queue_duration,
        CASE WHEN o_custkey % 17 <> 0 THEN 'user' || (o_custkey % 50) || '@example.com' END
            AS creator,
        CASE WHEN o_custkey % 2 = 0 THEN 'PERIODIC' ELSE 'ONE_TIME' END AS trigger_kind,
        CASE WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'TERMINATED' END AS state,
        CASE WHEN o_orderstatus = 'O' THEN 'SUCCESS'
            WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'CANCELED'
            WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'TIMEDOUT'
            WHEN o_orderstatus = 'F' THEN 'FAILED' END AS result_state,
        CASE WHEN o_custkey % 3 = 0 THEN 'c-' || (o_custkey % 10) END AS run_cluster,
        CASE o_custkey % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' WHEN 2 THEN 'gcp' END AS cloud,
        coalesce(n_tasks, 0) AS n_tasks
    FROM orders LEFT JOIN loads ON l_orderkey = o_orderkey)"""

TASKS = f"""{RUNS},
tasks AS (
    SELECT r.*, r.job_run_id * 1000 + i AS task_run_id, q * 60000 AS task_duration,
        CASE WHEN l_suppkey % 3 <> 0 THEN 'c-' || (l_suppkey % 10) END AS task_cluster,
        CASE WHEN end_time > 0 THEN end_time - start_time ELSE api_duration END AS run_duration,
        coalesce(run_cluster, CASE WHEN l_suppkey % 3 <> 0 THEN 'c-' || (l_suppkey % 10) END,
            'Serverless') AS cluster_id,
        CASE WHEN i IS NOT NULL THEN coalesce(end_time, 0) >= {INTERVAL_MS} END AS in_interval
    FROM runs r LEFT JOIN items ON l_orderkey = r.job_run_id)"""

# Runs as pages list them: again for every further 100 tasks.
LISTED = f"""{RUNS},
repeats AS (
    SELECT *, unnest(generate_series(0, greatest((n_tasks - 1) // 100, 0))) AS chunk FROM runs),
listed AS (
    SELECT * REPLACE (greatest(least(n_tasks - chunk * 100, 100), 0) AS n_tasks),
        job_run_id // 100 AS page,
        'p' || (job_run_id // 100) || CASE WHEN chunk > 0 THEN '.' || chunk ELSE '' END
            AS page_token
    FROM repeats)"""

PAGES = f"""{LISTED},
pages AS (
    SELECT page, page_token, count(*) AS n_runs, CAST(sum(n_tasks) AS BIGINT) AS n_tasks,
        coalesce(lead(page_token) OVER (PARTITION BY page ORDER BY chunk),
            CASE WHEN page < (SELECT max(o_orderkey) // 100 FROM orders)
            THEN 'p' || (page + 1) END, '') AS next_page_token
    FROM listed GROUP BY page, page_token, chunk)"""

SAMPLES = """
readings AS (
    SELECT event_id, event_type, user_id, ts, 'h-' || (user_id % 10) AS host,
        'app-' || (user_id % 5) AS app,
        CASE WHEN user_id % 4 = 0 THEN 'driver' ELSE CAST(user_id % 4 AS VARCHAR) END AS owner,
        CAST(floor(value * 100 + 0.5) AS BIGINT) AS v
    FROM events),
named AS (
    SELECT *, CASE
        WHEN event_type = 'view' AND event_id % 2 = 0 THEN app || '.' || owner || '.executor.bytesRead'
        WHEN event_type = 'view' THEN app || '.' || owner || '.executor.shuffleBytesWritten'
        WHEN event_type = 'signup' THEN app || '.' || owner || '.executor.jvmGCTime'
        WHEN event_type = 'purchase' AND event_id % 3 = 1
            THEN app || '.driver.appStatus.jobs.succeededJobs'
        WHEN event_type = 'purchase' AND event_id % 3 = 2
            THEN app || '.driver.appStatus.jobs.failedJobs'
        WHEN event_type = 'purchase' THEN app || '.driver.DAGScheduler.job.activeJobs'
        WHEN event_type = 'click' AND event_id % 3 = 0
            THEN app || '.' || owner || '.ExecutorMetrics.JVMHeapMemory'
        WHEN event_type = 'click' AND event_id % 3 = 1 THEN app || '.' || owner || '.JVMCPU.jvmCpuTime'
        WHEN event_type = 'click' THEN app || '.' || owner || '.ExecutorMetrics.MajorGCTime'
        WHEN event_id % 12 = 0 THEN 'application.' || app || '.' || user_id || '.cores'
        WHEN event_id % 12 = 4 THEN 'application.' || app || '.' || user_id || '.runtime_ms'
        WHEN event_id % 12 = 8 THEN 'application.' || app || '.' || user_id || '.status'
        WHEN event_id % 12 = 1 THEN 'worker.coresUsed'
        WHEN event_id % 12 = 5 THEN 'master.aliveWorkers'
        WHEN event_id % 12 = 9 THEN 'worker.memUsed_MB'
        WHEN event_id % 12 = 2 THEN 'worker.coresFree'
        WHEN event_id % 12 = 6 THEN 'master.workers'
        WHEN event_id % 12 = 10 THEN 'worker.memFree_MB'
        ELSE 'nodots' END AS name,
        event_type IN ('view', 'signup') OR (event_type = 'purchase' AND event_id % 3 <> 0)
            AS counts_up
    FROM readings),
samples AS (
    SELECT ts, host,
        CASE WHEN name = 'nodots' THEN name
            WHEN counts_up THEN 'metrics:name=' || name || ',type=counters'
            ELSE 'metrics:name=' || name || ',type=gauges' END AS mbean,
        CASE WHEN counts_up THEN 'Count' ELSE 'Value' END AS attribute,
        CAST(CASE WHEN counts_up THEN sum(v) OVER (
                PARTITION BY counts_up, name, date_trunc('day', ts) ORDER BY ts)
            WHEN event_type = 'error' AND event_id % 12 = 8 THEN NULL
            ELSE v END AS DOUBLE) AS value,
        CASE WHEN event_type = 'error' AND event_id % 12 = 8
            THEN CASE WHEN v % 2 = 0 THEN 'RUNNING' ELSE 'FINISHED' END END AS status
    FROM named)"""


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _catalogue() -> str:
    rows = []
    for leaf in mapped_leaves():
        regex = leaf.pattern.replace(".", "[.]").replace("*", ".*")
        cells = (leaf.stream, leaf.field, leaf.kind, leaf.attribute, leaf.bean_type, regex)
        rows.append("(" + ", ".join(map(_text, cells)) + ")")
    return ",\n        ".join(rows)


MATCHED = f"""{SAMPLES},
catalogue(stream, field, kind, attribute, bean_type, regex) AS (VALUES
        {_catalogue()}),
names AS (SELECT DISTINCT mbean, attribute FROM samples),
hits AS (
    SELECT mbean, n.attribute, stream, field, kind
    FROM names n JOIN catalogue c ON n.attribute = c.attribute
        AND regexp_full_match(mbean, 'metrics:name=' || regex || ',type=' || bean_type)),
matched AS (SELECT s.*, stream, field, kind FROM samples s JOIN hits USING (mbean, attribute))"""

RATED = f"""{MATCHED},
ordered AS (
    SELECT *, lag(value) OVER w AS before, lag(ts) OVER w AS before_ts
    FROM matched WINDOW w AS (PARTITION BY host, mbean, stream, field ORDER BY ts)),
rated AS (
    SELECT *, CASE WHEN before IS NULL THEN NULL WHEN value < before THEN value
        ELSE value - before END AS delta,
        CAST(epoch_us(ts) - epoch_us(before_ts) AS DOUBLE) / CAST(1e6 AS DOUBLE) AS passed
    FROM ordered)"""

# Application and id in a metric name, as the driver and executor streams read it.
PARSED = f"""{SAMPLES},
parts AS (
    SELECT ts, host, mbean,
        NOT contains(mbean, 'name=worker.') AND NOT contains(mbean, 'name=application.') AS applies,
        string_split(string_split(mbean, '=')[2], '.')[1] AS application,
        string_split(string_split(mbean, '=')[2], '.')[2] AS owner,
        string_split(mbean, '.') AS dotted
    FROM samples)"""

LINES = """
split_lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents),
lines AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, CAST(pos AS BIGINT) AS pos,
        CASE WHEN (doc_id + pos) % 4 = 0 THEN '24/01/02 03:04:05 INFO ' || line ELSE line END
            AS value
    FROM split_lines)"""


def log_event_ctes(max_lines: int) -> str:
    return f"""{LINES},
numbered AS (
    SELECT *, CAST(sum(CASE WHEN regexp_matches(value, '^\\d{{2}}/\\d{{2}}/\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}')
        THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS BIGINT) AS event_seq
    FROM lines),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY file, event_seq ORDER BY pos) AS nth FROM numbered),
log_events AS (
    SELECT file, event_seq, min(pos) AS pos,
        string_agg(value, chr(10) ORDER BY pos) FILTER (WHERE nth <= {max_lines}) AS message,
        count(*) AS n_lines, count(*) > {max_lines} AS truncated
    FROM placed GROUP BY file, event_seq)"""


LOG_PATH = """CASE WHEN doc_id % 2 = 1 THEN '/logs/driver/logs/stdout-' || file
    ELSE '/logs/spark/work/app-0/1/stderr-' || file END"""
LOG_DATASET = "CASE WHEN doc_id % 2 = 1 THEN 'spark.driver' ELSE 'spark.executor' END"

NODES = """
nodes AS (
    SELECT 'h-' || s_suppkey AS host,
        CASE WHEN s_suppkey % 10 NOT IN (7, 9) AND s_suppkey % 4 = 0 THEN 'Driver'
            ELSE 'Executor' END AS node_role,
        'c-' || (s_suppkey % 10) AS cluster_id, '10.0.0.' || (s_suppkey % 250) AS container_ip,
        'type-' || (s_nationkey % 3) AS instance_type, s_name AS cluster_name,
        CASE WHEN s_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS is_job_cluster
    FROM supplier)"""

# Facts as of a time: hosts are in another cluster before, those of even number ten days after too.
MOVING = f"""{NODES},
moving AS (
    SELECT nodes.*, CAST(substr(host, 3) AS BIGINT) % 2 = 0 AS comes_back FROM nodes)"""


def cluster_at(ts: str) -> str:
    return f"""CASE WHEN moving.host IS NULL THEN NULL WHEN {ts} < TIMESTAMP '2024-01-16' THEN 'c-old'
        WHEN comes_back AND {ts} >= TIMESTAMP '2024-01-26' THEN 'c-old' ELSE cluster_id END"""


_SET_LIST = "[" + ", ".join(f"'system.{name}'" for name in METRIC_SETS) + "]"
SYSTEM = f"""
system_metrics AS (
    SELECT {_SET_LIST}[event_id % 12 + 1] AS dataset, ts, 'h-' || (user_id % 10) AS host, value
    FROM events)"""

REPEATED = """
once AS (
    SELECT event_id, ts, 1 AS arrival, 'h-' || (user_id % 10) AS host,
        'metrics:name=app-' || (user_id % 5) || '.' ||
        CASE WHEN user_id % 4 = 0 THEN 'driver' ELSE CAST(user_id % 4 AS VARCHAR) END ||
        '.ExecutorMetrics.JVMHeapMemory,type=gauges' AS mbean,
        CAST(floor(value * 100 + 0.5) AS DOUBLE) AS value
    FROM events)"""


def bucket_us(ts: str, hours: int) -> str:
    width = hours * 3_600_000_000
    return f"epoch_us({ts}) // {width} * {width}"


def ms_bucket_us(ms: str, hours: int) -> str:
    width = hours * HOUR_MS
    return f"{ms} // {width} * {width} * 1000"


def ms_to_us(column: str) -> str:
    return f"CASE WHEN {column} > 0 THEN {column} * 1000 END"


def ms_to_iso(column: str) -> str:
    return (
        f"CASE WHEN {column} > 0 THEN "
        f"strftime(make_timestamp({column} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END"
    )


def _outcome(column: str) -> str:
    return (
        f"CASE {column} WHEN 'SUCCESS' THEN 'success' WHEN 'FAILED' THEN 'failure' "
        "WHEN 'CANCELED' THEN 'unknown' END"
    )


def _wide(stream: str) -> str:
    columns = []
    for leaf in leaves_of(stream):
        name = leaf.field.replace(".", "_")
        if leaf.path == "mbean":
            value = "mbean"
        elif leaf.path == "application_name":
            value = "CASE WHEN owner_fits THEN application END"
        elif leaf.path == "id":
            value = "CASE WHEN owner_fits THEN owner END"
        elif leaf.path == "name":
            value = "dotted[2] || '.' || dotted[3]"
        elif leaf.pattern is None:
            value = f"CAST(NULL AS {'VARCHAR' if leaf.type == 'string' else leaf.type})"
        elif leaf.type == "string":
            value = f"CASE WHEN field = '{leaf.field}' THEN status END"
        else:
            value = f"CASE WHEN field = '{leaf.field}' THEN CAST(value AS {leaf.type}) END"
        columns.append(f"{value} AS {name}")
    fits = {
        "driver": "owner = 'driver'",
        "executor": "owner <> 'driver'",
        "application": "true",
    }[stream]
    error = {
        "driver": "executor id in the driver stream",
        "executor": "driver id in the executor stream",
        "application": "",
    }[stream]
    return f"""WITH {MATCHED},
parts AS (
    SELECT *, string_split(string_split(mbean, '=')[2], '.')[1] AS application,
        string_split(string_split(mbean, '=')[2], '.')[2] AS owner,
        string_split(mbean, '.') AS dotted
    FROM matched WHERE stream = '{stream}'),
checked AS (SELECT *, {fits} AS owner_fits FROM parts)
SELECT epoch_us(ts) AS ts, host,
    CASE WHEN NOT owner_fits THEN '{error}' END AS error_message,
    {", ".join(columns)}
FROM checked"""


def _summary(source: str, where: str, dims: str, increase: str = "CAST(NULL AS DOUBLE)") -> str:
    """Per group: increase, range, and the highest of the values sampled last."""
    return f"""SELECT {dims}, field, {increase} AS increase, min(value) AS min_value,
        max(value) AS max_value, max(struct_pack(at := ts, v := value)).v AS last_value
    FROM {source} WHERE {where} GROUP BY ALL"""


JOB_EVENT_COLUMNS = f"""
    'logs' AS data_stream_type, 'databricks.job_runs' AS data_stream_dataset,
    'default' AS data_stream_namespace, CAST({NOW_US} AS BIGINT) AS timestamp,
    CAST(job_id AS VARCHAR) AS job_job_id, CAST(job_run_id AS VARCHAR) AS job_job_run_id,
    CAST(job_run_id AS VARCHAR) AS job_run_id,
    CAST(job_run_id AS VARCHAR) AS job_original_attempt_run_id,
    run_number AS job_run_number, CAST(run_number AS VARCHAR) AS job_number_in_job,
    run_name AS job_run_name, run_page_url AS job_run_page_url, 'JOB_RUN' AS job_run_type,
    run_duration AS job_run_duration,
    {ms_to_us('start_time')} AS job_start_time, {ms_to_us('end_time')} AS job_end_time,
    setup_duration AS job_setup_duration, execution_duration AS job_execution_duration,
    CAST(0 AS BIGINT) AS job_cleanup_duration, queue_duration AS job_queue_duration,
    creator AS job_creator_user_name, state AS job_state_life_cycle_state,
    result_state AS job_state_result_state,
    'run ' || lower(state) AS job_state_state_message,
    coalesce(result_state IN ('CANCELED', 'TIMEDOUT'), false)
        AS job_state_user_cancelled_or_timedout,
    state AS job_status_state, result_state AS job_status_termination_details_code,
    CASE WHEN result_state = 'SUCCESS' THEN 'SUCCESS'
        WHEN result_state IS NOT NULL THEN 'CLIENT_ERROR' END
        AS job_status_termination_details_type,
    CAST(task_run_id AS VARCHAR) AS job_tasks_run_id,
    CASE WHEN task_run_id IS NOT NULL THEN start_time * 1000 END AS job_tasks_start_time,
    (start_time + task_duration) * 1000 AS job_tasks_end_time,
    CASE WHEN task_run_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS job_tasks_setup_duration,
    task_duration AS job_tasks_execution_duration,
    CASE WHEN task_run_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS job_tasks_cleanup_duration,
    CASE WHEN task_run_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS job_tasks_queue_duration,
    trigger_kind AS job_trigger,
    CASE WHEN trigger_kind = 'PERIODIC' THEN '0 0 * * * ?' END AS job_schedule_quartz_cron_expression,
    CASE WHEN trigger_kind = 'PERIODIC' THEN 'UTC' END AS job_schedule_timezone_id,
    CASE WHEN trigger_kind = 'PERIODIC' THEN 'UNPAUSED' END AS job_schedule_pause_status,
    CAST(NULL AS VARCHAR) AS job_task_run_id, CAST(NULL AS VARCHAR) AS job_task_task_key,
    CAST(NULL AS VARCHAR) AS job_task_description,
    CAST(NULL AS VARCHAR) AS job_task_state_life_cycle_state,
    CAST(NULL AS VARCHAR) AS job_task_state_result_state,
    CAST(NULL AS BIGINT) AS job_task_start_time, CAST(NULL AS BIGINT) AS job_task_end_time,
    CAST(NULL AS BIGINT) AS job_task_execution_duration"""

FULL_EVENT_COLUMNS = f"""{JOB_EVENT_COLUMNS},
    cluster_id AS databricks_cluster_id, CAST(NULL AS VARCHAR) AS databricks_cluster_name,
    CAST(NULL AS VARCHAR) AS databricks_workspace_id, CAST(NULL AS VARCHAR) AS databricks_node_role,
    CAST(NULL AS VARCHAR) AS databricks_container_ip,
    CAST(NULL AS VARCHAR) AS databricks_instance_type,
    CAST(NULL AS VARCHAR) AS databricks_is_job_cluster,
    CAST(job_run_id AS VARCHAR) AS event_id, 'event' AS event_kind, 'info' AS event_type,
    'process' AS event_category, 'databricks' AS event_module,
    'databricks.job_runs' AS event_dataset,
    {ms_to_us('start_time')} AS event_start, {ms_to_us('end_time')} AS event_end,
    CASE WHEN run_duration > 0 THEN run_duration * 1000000 END AS event_duration,
    {_outcome('result_state')} AS event_outcome, creator AS user_name,
    cloud AS cloud_provider, creator AS related_user, '8.11.0' AS ecs_version,
    'prod' AS tags,
    CAST(NULL AS VARCHAR) AS error_message"""

# Terminated rows once, rows of open runs as often as they were polled.
JOB_EVENTS = f"""WITH {TASKS},
polled AS (
    SELECT *, 1 AS poll, 0 AS later_ms FROM tasks
    UNION ALL
    SELECT *, 2 AS poll, {POLL_GAP_MS} AS later_ms FROM tasks WHERE job_run_id % 5 = 0)
SELECT {FULL_EVENT_COLUMNS.replace(f"CAST({NOW_US} AS BIGINT)", f"{NOW_US} + later_ms * 1000")}
FROM polled
WHERE start_time >= {LOOKBACK_MS} + later_ms AND (poll = 1 OR state <> 'TERMINATED')
    AND NOT coalesce(state = 'TERMINATED' AND NOT in_interval, false)"""

_IDS = "SELECT job_run_id, task_run_id"


def oracle_sql() -> dict[str, str]:
    sql = {
        "run_pages_scan": f"WITH {PAGES} SELECT page_token, next_page_token, n_runs, n_tasks, "
        "false AS failed FROM pages UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM pages "
        "WHERE page % 5 = 2",
        "lookback_filter": f"WITH {RUNS} SELECT job_run_id, start_time FROM runs "
        f"WHERE start_time >= {LOOKBACK_MS}",
        "page_chain_audit": f"""WITH {PAGES}
SELECT p.next_page_token AS missing_token, CAST(1 AS BIGINT) AS n_pages,
    p.page_token AS first_page_token
FROM pages p WHERE p.page % 7 <> 3 AND p.next_page_token <> ''
    AND NOT EXISTS (SELECT 1 FROM pages n WHERE n.page_token = p.next_page_token AND n.page % 7 <> 3)""",
        "log_scan": f"WITH {LINES} SELECT {LOG_DATASET} AS dataset, value FROM lines",
        "log_exclude_gz": f"WITH {LINES} SELECT {LOG_PATH} AS path, count(*) AS n_lines "
        "FROM lines WHERE doc_id % 5 <> 0 GROUP BY 1",
        "log_route": f"WITH {LINES} SELECT {LOG_PATH} AS path, {LOG_DATASET} AS dataset, "
        "count(*) AS n_lines FROM lines GROUP BY 1, 2",
        "jmx_scan": f"WITH {SAMPLES} SELECT epoch_us(ts) AS ts, host, mbean, attribute, value, "
        "status FROM samples",
        "system_metrics_scan": f"WITH {SYSTEM} SELECT dataset, epoch_us(ts) AS ts, host, value "
        "FROM system_metrics",
        "split_runs": f"WITH {LISTED} SELECT page_token, job_run_id, job_id, run_name, "
        "n_tasks FROM listed",
        "split_tasks_keep_parent": f"WITH {TASKS} SELECT job_run_id, job_id, run_name, "
        "task_run_id, task_duration, task_cluster AS task_cluster_id FROM tasks",
        "decode_json_fields": f"""WITH {TASKS}
SELECT CASE WHEN job_run_id % 11 <> 0 THEN job_run_id END AS job_run_id,
    CASE WHEN job_run_id % 11 <> 0 THEN task_run_id END AS task_run_id, job_run_id AS key,
    CASE WHEN job_run_id % 11 <> 0 THEN run_name END AS run_name,
    CASE WHEN job_run_id % 11 <> 0 AND job_run_id % 13 <> 0 THEN result_state END AS result_state,
    CASE WHEN job_run_id % 11 <> 0 THEN task_duration END AS task_duration,
    job_run_id % 11 = 0 OR job_run_id % 13 = 0 AS failed
FROM tasks""",
        "interval_flag": f"WITH {TASKS} {_IDS}, in_interval AS is_within_interval_range FROM tasks",
        "drop_stale_terminated": f"WITH {TASKS} {_IDS}, state FROM tasks "
        "WHERE NOT coalesce(state = 'TERMINATED' AND NOT in_interval, false)",
        "epoch_to_time": f"WITH {TASKS} {_IDS}, {ms_to_iso('start_time')} AS start_time, "
        f"{ms_to_iso('end_time')} AS end_time FROM tasks",
        "run_duration": f"WITH {TASKS} {_IDS}, run_duration FROM tasks",
        "tags_apply": f"WITH {TASKS} {_IDS}, 'preserve_original_event,prod,spark' AS tags FROM tasks",
        "cluster_id_resolve": f"WITH {TASKS} {_IDS}, cluster_id FROM tasks",
        "event_start_end": f"WITH {TASKS} {_IDS}, CASE WHEN job_run_id % 13 <> 0 AND start_time > 0 "
        f"THEN start_time * 1000 END AS event_start, {ms_to_us('end_time')} AS event_end FROM tasks",
        "event_duration_ns": f"WITH {TASKS} {_IDS}, CASE WHEN run_duration > 0 "
        "THEN run_duration * 1000000 END AS event_duration FROM tasks",
        "event_outcome": f"WITH {TASKS} {_IDS}, {_outcome('result_state')} AS event_outcome FROM tasks",
        "related_user": f"""WITH {TASKS} {_IDS},
    CASE WHEN job_run_id % 2 = 1 OR creator IS NULL THEN CASE WHEN job_run_id % 2 = 0
            THEN 'user1@example.com' ELSE creator END
        WHEN creator = 'user1@example.com' THEN creator
        ELSE 'user1@example.com,' || creator END AS related_user
FROM tasks""",
        "cloud_provider": f"WITH {TASKS} {_IDS}, cloud AS cloud_provider FROM tasks",
        "original_retention": f"WITH {TASKS} {_IDS}, CASE WHEN job_run_id % 3 = 0 "
        "THEN 'run ' || job_run_id END AS event_original FROM tasks",
        "job_error_capture": f"""WITH {TASKS}
SELECT job_run_id AS key, CASE WHEN job_run_id % 5 = 0 THEN 'earlier' WHEN job_run_id % 11 = 0
    THEN 'Pipeline processing failed: message is not a JSON object' WHEN job_run_id % 13 = 0
    THEN 'Pipeline processing failed: state of message cannot be read' END AS error_message
FROM tasks""",
        "job_schema_cast": f"""WITH {TASKS}
SELECT * EXCLUDE (data_stream_type, data_stream_dataset, data_stream_namespace, timestamp)
    REPLACE (CASE WHEN CAST(job_job_run_id AS BIGINT) % 4 <> 0 THEN job_run_number END
        AS job_run_number)
FROM (SELECT {JOB_EVENT_COLUMNS} FROM (SELECT * REPLACE (api_duration AS run_duration) FROM tasks))""",
        "dedup_terminated": f"""WITH {TASKS}
SELECT CASE WHEN job_run_id % 3 <> 0 THEN job_run_id END AS job_run_id, task_run_id,
    job_run_id AS key, poll, state
FROM tasks, (VALUES (1), (2)) polls(poll)
WHERE poll = 1 OR job_run_id % 5 = 0 AND (state <> 'TERMINATED' OR job_run_id % 15 = 0)""",
        "event_identity": f"WITH {TASKS} {_IDS}, CAST(job_run_id AS VARCHAR) AS event_id, "
        "creator AS user_name FROM tasks",
        "job_events": JOB_EVENTS,
        "jmx_catalogue_match": f"WITH {MATCHED} SELECT epoch_us(ts) AS ts, host, mbean, attribute, "
        "value, status, stream, field, kind FROM matched",
        "jmx_select_attr": f"WITH {MATCHED} SELECT stream, field, attribute, count(*) AS n_samples "
        "FROM matched GROUP BY ALL",
        "metric_namespace": f"""WITH {MATCHED}
SELECT epoch_us(ts) AS ts, host,
    CASE WHEN field = 'application.cores' THEN CAST(value AS BIGINT) END AS application_cores,
    CASE WHEN stream = 'application' THEN mbean END AS application_mbean,
    CAST(NULL AS VARCHAR) AS application_name,
    CASE WHEN field = 'application.runtime.ms' THEN CAST(value AS BIGINT) END
        AS application_runtime_ms,
    CASE WHEN field = 'application.status' THEN status END AS application_status,
    '8.11.0' AS ecs_version, 'info' AS event_type, 'metric' AS event_kind,
    'databricks' AS event_module
FROM matched WHERE stream IN ('application', 'node')""",
        "driver_name_parse": f"""WITH {PARSED}
SELECT epoch_us(ts) AS ts, host, mbean,
    CASE WHEN applies AND owner = 'driver' THEN application END AS application_name,
    CAST(NULL AS VARCHAR) AS id,
    CASE WHEN NOT applies THEN NULL
        WHEN owner IS NULL THEN 'no application and id in metric name'
        WHEN owner <> 'driver' THEN 'executor id in the driver stream' END AS failure
FROM parts""",
        "executor_name_parse": f"""WITH {PARSED}
SELECT epoch_us(ts) AS ts, host, mbean,
    CASE WHEN applies AND owner <> 'driver' THEN application END AS application_name,
    CASE WHEN applies AND owner <> 'driver' THEN owner END AS id,
    CASE WHEN NOT applies THEN NULL
        WHEN owner IS NULL THEN 'no application and id in metric name'
        WHEN owner = 'driver' THEN 'driver id in the executor stream' END AS failure
FROM parts""",
        "application_name_parse": f"""WITH {PARSED}
SELECT epoch_us(ts) AS ts, host, mbean,
    CASE WHEN NOT contains(mbean, 'name=application') THEN NULL
        WHEN NOT contains(dotted[1], 'name=application') THEN ''
        WHEN len(dotted) >= 3 THEN dotted[2] || '.' || dotted[3] END AS application_name,
    CAST(NULL AS VARCHAR) AS id,
    CASE WHEN contains(dotted[1], 'name=application') AND len(dotted) < 3
        THEN 'no application in metric name' END AS failure
FROM parts""",
        "metric_error_rows": f"""WITH {MATCHED}
SELECT epoch_us(ts) AS ts, host, 'driver id in the executor stream' AS error_message,
    mbean AS payload_mbean, value AS payload_value, CAST(NULL AS VARCHAR) AS application_name,
    CAST(NULL AS VARCHAR) AS id
FROM matched WHERE stream = 'executor'
    AND string_split(string_split(mbean, '=')[2], '.')[2] = 'driver'""",
        "driver_metrics": _wide("driver"),
        "executor_metrics": _wide("executor"),
        "application_metrics": _wide("application"),
        "tsds_dedup": f"""WITH {REPEATED}
SELECT epoch_us(ts) AS ts, host, mbean, NULL AS stream, 'Value' AS attribute, value, arrival FROM once
UNION ALL
SELECT epoch_us(ts), host, mbean, NULL, 'Count', value * 2, arrival FROM once
UNION ALL
SELECT epoch_us(ts), host, mbean, 'executor', 'Value', value, arrival FROM once
UNION ALL
SELECT epoch_us(ts), host, mbean, 'driver', 'Value', value, arrival FROM once
WHERE contains(mbean, '.driver.')""",
        "counter_rate": f"""WITH {RATED}
SELECT epoch_us(ts) AS ts, host, mbean, stream, field, value, delta, delta / passed AS rate
FROM rated WHERE kind = 'counter'""",
        "gauge_rollup": f"""WITH {MATCHED}
SELECT {bucket_us('ts', 24)} AS bucket, host, mbean, stream, field, min(value) AS min_value,
    max(value) AS max_value, sum(value) / count(value) AS avg_value,
    arg_max(value, ts) AS last_value, count(value) AS n_samples
FROM matched WHERE kind = 'gauge' GROUP BY ALL""",
        "sample_gaps": f"""WITH {RATED}
SELECT host, mbean, stream, field, epoch_us(before_ts) AS gap_start, epoch_us(ts) AS gap_end,
    passed AS gap_seconds
FROM rated WHERE passed > 21600""",
        "log_multiline": f"WITH {log_event_ctes(NO_LIMIT)} SELECT file, event_seq, message, n_lines, "
        "truncated FROM log_events",
        "log_max_lines": f"WITH {log_event_ctes(3)} SELECT file, event_seq, message, n_lines, "
        "truncated FROM log_events",
        "log_multiline_stream": f"WITH {log_event_ctes(NO_LIMIT)} SELECT file, pos, message, n_lines, "
        "truncated FROM log_events",
        "log_event_table": f"""WITH {log_event_ctes(1000)}, {NODES.strip()}
SELECT 'h-' || (CAST(file AS BIGINT) % 100) AS host, file, event_seq, message, n_lines, truncated,
    {LOG_PATH.replace("doc_id", "CAST(file AS BIGINT)")} AS path,
    coalesce(node_role, 'Executor') AS node_role, cluster_id,
    container_ip, instance_type, cluster_name, is_job_cluster, 'logs' AS data_stream_type,
    {LOG_DATASET.replace("doc_id", "CAST(file AS BIGINT)")} AS data_stream_dataset,
    'databricks' AS data_stream_namespace
FROM log_events LEFT JOIN nodes ON nodes.host = 'h-' || (CAST(file AS BIGINT) % 100)""",
        "node_role": f"WITH {NODES} SELECT host, node_role FROM nodes",
        "node_facts_join": f"""WITH {SAMPLES}, {NODES}
SELECT host, epoch_us(ts) AS ts, mbean, coalesce(node_role, 'Executor') AS node_role, cluster_id,
    container_ip, instance_type, cluster_name, is_job_cluster
FROM samples LEFT JOIN nodes USING (host)""",
        "node_facts_asof": f"""WITH {SAMPLES}, {MOVING.strip()}
SELECT samples.host, epoch_us(ts) AS ts, mbean, coalesce(node_role, 'Executor') AS node_role,
    {cluster_at('ts')} AS cluster_id, container_ip, instance_type, cluster_name, is_job_cluster
FROM samples LEFT JOIN moving ON moving.host = samples.host""",
        "system_metrics_stored": f"""WITH {SYSTEM}, {MOVING.strip()}
SELECT s.host, epoch_us(ts) AS ts, value, coalesce(node_role, 'Executor') AS node_role,
    {cluster_at('ts')} AS cluster_id, container_ip, instance_type, cluster_name, is_job_cluster,
    'metrics' AS data_stream_type, dataset AS data_stream_dataset,
    'databricks' AS data_stream_namespace
FROM system_metrics s LEFT JOIN moving ON moving.host = s.host""",
        "stream_log_event_table": f"""WITH {log_event_ctes(NO_LIMIT)}, {NODES.strip()}
SELECT 'h-' || (CAST(file AS BIGINT) % 100) AS host, file, pos, message, n_lines, truncated,
    {LOG_PATH.replace("doc_id", "CAST(file AS BIGINT)")} AS path,
    coalesce(node_role, 'Executor') AS node_role, cluster_id,
    container_ip, instance_type, cluster_name, is_job_cluster, 'logs' AS data_stream_type,
    {LOG_DATASET.replace("doc_id", "CAST(file AS BIGINT)")} AS data_stream_dataset,
    'databricks' AS data_stream_namespace
FROM log_events LEFT JOIN nodes ON nodes.host = 'h-' || (CAST(file AS BIGINT) % 100)""",
        "stream_table_counts": f"""WITH {MATCHED}, {log_event_ctes(NO_LIMIT).strip()}, {SYSTEM.strip()}
SELECT 'logs-' || CASE WHEN CAST(file AS BIGINT) % 2 = 1 THEN 'spark.driver' ELSE 'spark.executor' END
    || '-databricks' AS stream_name, count(*) AS n_rows FROM log_events GROUP BY 1
UNION ALL
SELECT 'metrics-' || dataset || '-databricks', count(*) FROM system_metrics GROUP BY 1
UNION ALL
SELECT 'metrics-databricks.spark_' || stream || '-default', count(*) FROM matched GROUP BY 1""",
        "stream_table_counts_by_batch": f"""WITH {MATCHED}, {SYSTEM.strip()}
SELECT 'metrics-' || dataset || '-databricks' AS stream_name, count(*) AS n_rows
FROM system_metrics GROUP BY 1
UNION ALL
SELECT 'metrics-databricks.spark_' || stream || '-databricks', count(*) FROM matched GROUP BY 1""",
        "dataset_normalise": f"WITH {MATCHED} SELECT 'databricks.spark_' || stream AS dataset, "
        "count(*) AS n_rows FROM matched GROUP BY 1",
        "run_totals": f"""WITH {RUNS}
SELECT count(*) AS total_runs, count(*) FILTER (WHERE result_state = 'SUCCESS') AS success_runs,
    count(*) FILTER (WHERE result_state = 'FAILED') AS failed_runs,
    count(*) FILTER (WHERE result_state = 'CANCELED') AS canceled_runs
FROM runs""",
        "runs_timeline": f"WITH {RUNS} SELECT {ms_bucket_us('start_time', 24)} AS bucket, "
        "result_state, count(*) AS n_runs FROM runs GROUP BY 1, 2",
        "run_detail_table": f"""WITH {TASKS}
SELECT CAST(job_run_id AS VARCHAR) AS job_run_id, CAST(task_run_id AS VARCHAR) AS task_run_id,
    run_name, CAST(job_id AS VARCHAR) AS job_id, result_state,
    {ms_to_us('start_time')} AS start_time, {ms_to_us('end_time')} AS end_time, run_duration,
    creator AS creator_user_name, cluster_id, result_state AS termination_code
FROM tasks
ORDER BY tasks.start_time DESC NULLS LAST, CAST(tasks.job_run_id AS VARCHAR),
    CAST(tasks.task_run_id AS VARCHAR) NULLS FIRST""",
        "duration_pretty": f"""WITH {TASKS}
SELECT CAST(job_run_id AS VARCHAR) AS job_run_id, CAST(task_run_id AS VARCHAR) AS task_run_id,
    run_duration,
    (run_duration // 3600000) || 'h ' || (run_duration // 60000 % 60) || 'm '
        || (run_duration // 1000 % 60) || 's' AS duration
FROM tasks""",
        "control_filter": f"""WITH {TASKS}
SELECT CAST(job_run_id AS VARCHAR) AS job_run_id, CAST(task_run_id AS VARCHAR) AS task_run_id,
    run_name, cluster_id
FROM tasks WHERE run_name IN ('job_1', 'job_2') AND cluster_id IN ('c-1', 'Serverless')""",
        "control_options": f"""WITH {TASKS}
SELECT 'job_name' AS control, run_name AS value, count(DISTINCT job_run_id) AS n_runs
FROM tasks GROUP BY 2
UNION ALL
SELECT 'job_id', CAST(job_id AS VARCHAR), count(DISTINCT job_run_id) FROM tasks GROUP BY 2
UNION ALL
SELECT 'job_run_id', CAST(job_run_id AS VARCHAR), count(DISTINCT job_run_id) FROM tasks GROUP BY 2
UNION ALL
SELECT 'cluster_id', cluster_id, count(DISTINCT job_run_id) FROM tasks GROUP BY 2""",
        "time_range": f"""WITH {TASKS}
SELECT CAST(job_run_id AS VARCHAR) AS job_run_id, CAST(task_run_id AS VARCHAR) AS task_run_id,
    start_time * 1000 AS start_time
FROM tasks WHERE start_time >= epoch_ms(TIMESTAMP '1998-01-01')
    AND start_time < epoch_ms(TIMESTAMP '1999-01-01')""",
        "run_trend": """WITH daily AS (
    SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_runs FROM orders GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, n_runs,
    CAST(sum(n_runs) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) AS moving_average
FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        "failed_job_alert": f"""WITH {RUNS}
SELECT CAST(job_id AS VARCHAR) AS job_id, {ms_bucket_us('start_time', 2160)} AS bucket,
    count(*) AS failed_runs
FROM runs WHERE result_state = 'FAILED' GROUP BY 1, 2 HAVING count(*) >= 2""",
        "application_panel": f"""WITH {MATCHED},
apps AS (
    SELECT *, string_split(mbean, '.')[2] || '.' || string_split(mbean, '.')[3] AS application_name
    FROM matched WHERE stream = 'application')
SELECT application_name,
    CAST(arg_max(value, ts) FILTER (WHERE field = 'application.runtime.ms') AS BIGINT) AS runtime_ms,
    CAST(arg_max(value, ts) FILTER (WHERE field = 'application.cores') AS BIGINT) AS cores,
    arg_max(status, ts) FILTER (WHERE field = 'application.status') AS status
FROM apps GROUP BY 1""",
        "driver_panel": f"""WITH {RATED},
shown AS (
    SELECT *, string_split(string_split(mbean, '=')[2], '.')[1] AS application_name
    FROM rated WHERE stream = 'driver'
        AND regexp_matches(field, '^driver[.](jobs|stages|tasks|dag_scheduler)[.]'))
SELECT application_name, field,
    sum(CASE WHEN kind = 'counter' THEN delta END) AS increase,
    arg_max(value, ts) AS last_value
FROM shown GROUP BY 1, 2""",
        "executor_panel": f"""WITH {RATED},
shown AS (
    SELECT *, string_split(string_split(mbean, '=')[2], '.')[1] AS application_name,
        string_split(string_split(mbean, '=')[2], '.')[2] AS id
    FROM rated WHERE stream = 'executor' AND kind = 'counter'
        AND (regexp_matches(field, '^executor[.](bytes|records|shuffle)[.]')
            OR contains(field, 'bytes_spilled')))
SELECT application_name, id, field, sum(delta) AS increase, max(delta / passed) AS peak_rate,
    count(*) AS n_samples
FROM shown WHERE id <> 'driver' GROUP BY 1, 2, 3""",
        "memory_cpu_panel": f"""WITH {MATCHED},
shown AS (SELECT *, {bucket_us('ts', 24)} AS bucket FROM matched),
summary AS ({_summary('shown', "regexp_matches(field, 'jvm[.](heap|off_heap|cpu_time|cpu[.]time)$')",
    'host, bucket')})
SELECT * EXCLUDE (increase) FROM summary""",
        "gc_panel": f"""WITH {RATED}
{_summary('rated', "contains(field, '.gc.')", 'host')}
UNION ALL
{_summary('rated', "field = 'executor.jvm.gc_time'", 'host', 'sum(delta)')}""",
    }
    leaves = leaves_of("node")
    folded = ", ".join(
        f"CAST(max(value) FILTER (WHERE field = '{leaf.field}') AS BIGINT) "
        f"AS databricks_{leaf.field.replace('.', '_')}"
        for leaf in leaves
    )
    sql["node_metrics"] = f"""WITH {MATCHED}
SELECT host, {bucket_us('ts', 24)} AS ts, {folded}
FROM matched WHERE stream = 'node' GROUP BY 1, 2"""
    sql["node_panel"] = f"""WITH rows_per_day AS ({sql['node_metrics']})
SELECT host, ts, databricks_node_main_workers_alive AS workers_alive,
    databricks_node_main_workers_count AS workers_count,
    CAST(databricks_node_worker_cores_used AS DOUBLE) / CAST(nullif(
        databricks_node_worker_cores_used + databricks_node_worker_cores_free, 0) AS DOUBLE)
        AS cores_used_share,
    CAST(databricks_node_worker_memory_used AS DOUBLE) / CAST(nullif(
        databricks_node_worker_memory_used + databricks_node_worker_memory_free, 0) AS DOUBLE)
        AS memory_used_share
FROM rows_per_day"""
    sql["stored_driver_metrics"] = f"""WITH wide AS ({sql["driver_metrics"]}), {NODES.strip()}
SELECT wide.*, coalesce(node_role, 'Executor') AS node_role, cluster_id, container_ip,
    instance_type, cluster_name, is_job_cluster, 'metrics' AS data_stream_type,
    'databricks.spark_driver' AS data_stream_dataset, 'default' AS data_stream_namespace
FROM wide LEFT JOIN nodes USING (host)"""
    sql["stream_job_events"] = JOB_EVENTS
    sql["gauge_rollup_levels"] = sql["gauge_rollup"]
    sql["run_totals_of_days"] = sql["run_totals"]
    sql["runs_timeline_of_days"] = (
        f"WITH {RUNS} SELECT {ms_bucket_us('start_time', 72)} AS bucket, "
        "result_state, count(*) AS n_runs FROM runs GROUP BY 1, 2"
    )
    sql["control_options_of_days"] = (
        f"SELECT * FROM ({sql['control_options']}) WHERE control <> 'job_run_id'"
    )
    sql["stream_page_chain_audit"] = (
        f"SELECT missing_token, first_page_token AS named_by FROM ({sql['page_chain_audit']})"
    )
    sql["stream_status_counts"] = f"""WITH {RUNS},
counts AS (
    SELECT {ms_bucket_us('start_time', 24)} AS bucket, result_state, count(*) AS n_runs
    FROM runs GROUP BY 1, 2)
SELECT * FROM counts"""
    minute = "epoch_us(ts) // 60000000 * 60000000"
    sql["stream_gauge_rollup"] = f"""WITH {REPEATED},
rolled AS (
    SELECT {minute} AS bucket, host, mbean, 'executor' AS stream,
        'executor.memory.jvm.heap' AS field, min(value) AS min_value, max(value) AS max_value,
        sum(value) / count(value) AS avg_value, arg_max(value, ts) AS last_value,
        count(value) AS n_samples
    FROM once GROUP BY ALL)
SELECT * FROM rolled"""
    return sql

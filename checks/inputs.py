"""Telemetry inputs derived from the given tables: orders and line items stand for job
runs and tasks, events for metric samples, documents for log files, suppliers for nodes.

The costly ones are landed once per session; the others are cached as lazy plans.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.sequences import (
    dealt,
    with_row_number_sliced,
    with_running_total,
)
from tidewatch.operators.job_runs import as_job, split_tasks
from tidewatch.schema.fixed_values import METRIC_SETS
from tidewatch.schema.source_types import RUN_FIELDS
from tidewatch.session import scratch_path

NOW = datetime(2001, 8, 2, tzinfo=timezone.utc)
REQUEST_INTERVAL = "8760h"
LOOKBACK = "43800h"

# Tasks listed with a run at once; a run with more is listed again with the next ones.
TASKS_LISTED = 100
# Runs with their tasks that a task is dealt to gather pages.
RUNS_DEALT = 50_000
# The second poll comes so much later.
POLL_GAP = timedelta(hours=720)


def landed(build: Callable[[SparkSession, str], DataFrame]):
    """The input, written once per session and tables below the shared folder and read from there,
    so that queries neither build it again nor are timed with it."""

    @cache
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, f"input-{build.__name__}")
        build(spark, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str | Column) -> Column:
    """A zone-less time of the given tables as a timestamp (the session runs in UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("timestamp")


# --- job runs ---------------------------------------------------------------------


def _task_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks per order in lists of up to TASKS_LISTED.

    Line items are numbered per order in slices, so that no order has to fit a task.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.floor(F.col("l_partkey") / 256).alias("part_range"),
    )
    numbered = with_row_number_sliced(
        items,
        ["l_orderkey"],
        ["l_linenumber", "part_range"],
        ["l_partkey", "l_suppkey", "quantity"],
        "i",
    )
    task = F.expr(
        """struct(i, l_orderkey * 1000 + i AS run_id, quantity,
            if(l_suppkey % 3 <> 0, 'c-' || (l_suppkey % 10), NULL) AS cluster_id)"""
    )
    chunk = F.floor((F.col("i") - 1) / TASKS_LISTED).alias("chunk")
    lists = numbered.groupBy("l_orderkey", chunk).agg(
        F.sum("quantity").alias("quantity"), F.array_sort(F.collect_list(task)).alias("listed")
    )
    # One row per list: an order's total is a window over its few lists.
    whole = Window.partitionBy("l_orderkey")
    return lists.withColumn("total", F.sum("quantity").over(whole)).drop("quantity")


_RESULT = """CASE WHEN o_orderstatus = 'O' THEN 'SUCCESS'
    WHEN o_orderstatus <> 'F' THEN NULL
    WHEN o_orderpriority = '5-LOW' THEN 'CANCELED'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'TIMEDOUT'
    ELSE 'FAILED' END"""

# From an order with ``started``, ``spent`` (ms), ``result``, ``chunk`` and ``listed``.
_RUN = """
    o_custkey AS job_id,
    o_orderkey AS job_run_id,
    o_orderkey AS run_id,
    o_orderkey AS original_attempt_run_id,
    o_orderkey % 1000 AS run_number,
    o_orderkey % 1000 AS number_in_job,
    'job_' || (o_custkey % 20) AS run_name,
    'https://x/#job/' || o_custkey || '/run/' || o_orderkey AS run_page_url,
    'JOB_RUN' AS run_type,
    o_orderkey % 7 * 1000 AS run_duration,
    started AS start_time,
    CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderkey % 97 <> 0 THEN started + spent END
        AS end_time,
    o_custkey % 5 * 1000 AS setup_duration,
    spent AS execution_duration,
    0L AS cleanup_duration,
    o_orderkey % 3 * 100 AS queue_duration,
    CASE WHEN o_custkey % 17 <> 0 THEN 'user' || (o_custkey % 50) || '@example.com' END
        AS creator_user_name,
    if(o_custkey % 2 = 0, 'PERIODIC', 'ONE_TIME') AS `trigger`,
    named_struct(
        'life_cycle_state', if(o_orderstatus = 'P', 'RUNNING', 'TERMINATED'),
        'result_state', result,
        'state_message', 'run ' || if(o_orderstatus = 'P', 'running', 'terminated'),
        'user_cancelled_or_timedout', coalesce(result IN ('CANCELED', 'TIMEDOUT'), false)
    ) AS state,
    named_struct(
        'state', if(o_orderstatus = 'P', 'RUNNING', 'TERMINATED'),
        'termination_details', named_struct(
            'code', result,
            'type', CASE WHEN result = 'SUCCESS' THEN 'SUCCESS'
                WHEN result IS NOT NULL THEN 'CLIENT_ERROR' END)
    ) AS status,
    CASE WHEN o_custkey % 2 = 0 THEN named_struct(
        'quartz_cron_expression', '0 0 * * * ?', 'timezone_id', 'UTC',
        'pause_status', 'UNPAUSED') END AS schedule,
    CASE WHEN o_custkey % 3 = 0 THEN named_struct('cluster_id', 'c-' || (o_custkey % 10)) END
        AS cluster_instance,
    transform(listed, t -> named_struct(
        'run_id', t.run_id,
        'start_time', started,
        'end_time', started + t.quantity * 60000,
        'setup_duration', 0L,
        'execution_duration', t.quantity * 60000,
        'cleanup_duration', 0L,
        'queue_duration', 0L,
        'cluster_instance',
            if(t.cluster_id IS NULL, NULL, named_struct('cluster_id', t.cluster_id))
    )) AS tasks,
    coalesce(chunk, 0L) AS chunk
"""


@landed
def listed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as pages list them, with ``chunk`` counting repeats of runs with many tasks."""
    orders = table(spark, sf_dir, "orders")
    lists = _task_lists(spark, sf_dir)
    rows = orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    timed = rows.select(
        "*",
        F.unix_millis(utc("o_orderdate")).alias("started"),
        F.expr("coalesce(total, 1) * 60000L").alias("spent"),
        F.expr(_RESULT).alias("result"),
    )
    return spark.sql(f"SELECT {_RUN} FROM {{timed}}", timed=timed)


@cache
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_runs(spark, sf_dir).drop("chunk")


def workspace_host(job_id: str | Column = "job_id") -> Column:
    job_id = F.col(job_id) if isinstance(job_id, str) else job_id
    hosts = (
        "https://x.cloud.databricks.com",
        "https://adb-1.2.azuredatabricks.net",
        "https://1.gcp.databricks.com",
    )
    column = F.lit("https://other.example")
    for number, host in enumerate(hosts):
        column = F.when(job_id % 4 == number, host).otherwise(column)
    return column


@landed
def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to 100 runs, each with the token of the next; the last has none.

    A page that holds runs with more tasks is followed by pages with their further tasks.
    """
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last_key"))
    return paged(
        listed_runs(spark, sf_dir), last.select(F.floor(F.col("last_key") / 100)).scalar()
    )


def paged(listed: DataFrame, last_page: Column) -> DataFrame:
    """Listed runs gathered to pages.  They are shuffled once; the chain takes the tokens alone."""
    listed = listed.withColumn("page", F.floor(F.col("job_run_id") / 100))
    number = F.concat(F.lit("p"), F.col("page"))
    of_page = Window.partitionBy("page").orderBy("chunk")
    token = F.when(F.col("chunk") == 0, number).otherwise(
        F.concat(number, F.lit("."), F.col("chunk"))
    )
    following = F.when(F.col("page") < last_page, F.concat(F.lit("p"), F.col("page") + 1))
    chain = listed.select("page", "chunk").distinct().withColumn("page_token", token)
    chain = chain.withColumn(
        "next_page_token", F.coalesce(F.lead("page_token").over(of_page), following)
    )
    # Dealt before they are gathered: lists half done are never sorted or spilled.
    by = ["page", "chunk"]
    pages = (
        dealt(listed.repartition(*by), listed.count(), by, RUNS_DEALT)
        .groupBy("page", "chunk")
        .agg(F.collect_list(F.struct(*RUN_FIELDS)).alias("runs"))
    )
    # Runs without a number meet no link; their page has no token either way.
    return pages.join(chain, ["page", "chunk"], "left").select(
        "page_token", F.coalesce("next_page_token", F.lit("")).alias("next_page_token"), "runs"
    )


def polled(df: DataFrame, key: str = "job_run_id") -> DataFrame:
    """Each row as seen by poll 1, and every fifth run by poll 2 as well."""
    polls = F.when(F.col(key) % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select("*", F.explode(polls).alias("poll"))


@landed
def polled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of both polls with the time of each; the second lists every fifth run again."""
    pages = run_pages(spark, sf_dir)
    twice = pages.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("poll"))
    again = F.expr("filter(runs, r -> r.job_run_id % 5 = 0)")
    fetched = F.when(F.col("poll") == 1, F.lit(NOW)).otherwise(F.lit(NOW + POLL_GAP))
    return twice.withColumns(
        {
            "runs": F.when(F.col("poll") == 1, F.col("runs")).otherwise(again),
            "fetched_at": fetched,
        }
    )


@cache
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run/task rows with the run in ``job``."""
    return as_job(split_tasks(runs(spark, sf_dir)))


@landed
def shipped_messages(spark, sf_dir) -> DataFrame:
    """Records as JSON text: every 11th cut short, every 7th with ``state`` as text, every
    13th with a ``state`` that is no JSON."""
    rows = split_tasks(runs(spark, sf_dir)).withColumn("key", F.col("job_run_id"))
    typed = F.to_json(F.struct(*RUN_FIELDS))
    texts = [F.to_json("state").alias(n) if n == "state" else n for n in RUN_FIELDS]
    odd = [F.lit("not json").alias(n) if n == "state" else n for n in RUN_FIELDS]
    message = (
        F.when(F.col("key") % 13 == 0, F.to_json(F.struct(*odd)))
        .when(F.col("key") % 7 == 0, F.to_json(F.struct(*texts)))
        .otherwise(typed)
    )
    cut = F.substring("message", F.lit(1), F.length("message") - 5)
    return rows.select("key", message.alias("message")).withColumn(
        "message", F.when(F.col("key") % 11 == 0, cut).otherwise(F.col("message"))
    )


# --- metric samples ---------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    owner = F.when(user % 4 == 0, "driver").otherwise((user % 4).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "user_id",
        utc("ts").alias("ts"),
        F.concat(F.lit("h-"), user % 10).alias("host"),
        F.concat(F.lit("app-"), user % 5).alias("app"),
        owner.alias("owner"),
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("v"),
    )


def _sample(name: Column, kind: str, attribute: str, value: Column, status: Column) -> list[Column]:
    return [
        F.col("ts"),
        F.lit(1).alias("arrival"),
        F.col("host"),
        F.when(name == "nodots", name)
        .otherwise(F.concat(F.lit("metrics:name="), name, F.lit(f",type={kind}")))
        .alias("mbean"),
        F.lit(attribute).alias("attribute"),
        value.cast("double").alias("value"),
        status.cast("string").alias("status"),
    ]


@landed
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JMX samples of the events; counters are running sums that start over each day.

    Counter and gauge samples are separate branches with a literal attribute, so a query
    for one kind prunes the other.
    """
    events = _events(spark, sf_dir)
    kind, number = F.col("event_type"), F.col("event_id")
    app, owner = F.col("app"), F.col("owner")
    owned = F.concat(app, F.lit("."), owner)
    counter = (
        F.when((kind == "view") & (number % 2 == 0), F.concat(owned, F.lit(".executor.bytesRead")))
        .when(kind == "view", F.concat(owned, F.lit(".executor.shuffleBytesWritten")))
        .when(kind == "signup", F.concat(owned, F.lit(".executor.jvmGCTime")))
        .when(
            (kind == "purchase") & (number % 3 == 1),
            F.concat(app, F.lit(".driver.appStatus.jobs.succeededJobs")),
        )
        .when(
            (kind == "purchase") & (number % 3 == 2),
            F.concat(app, F.lit(".driver.appStatus.jobs.failedJobs")),
        )
    )
    counts_up = kind.isin("view", "signup") | ((kind == "purchase") & (number % 3 != 0))
    counted = (
        events.filter(counts_up)
        .select("ts", "host", "v", counter.alias("name"))
        .withColumn("day", F.date_trunc("day", "ts"))
    )
    counted = with_running_total(counted, ["name", "day"], "ts", "v", "total")
    no_status = F.lit(None)
    counters = counted.select(
        *_sample(F.col("name"), "counters", "Count", F.col("total"), no_status)
    )

    user_app = F.concat(F.lit("application."), app, F.lit("."), F.col("user_id"))
    node_names = {
        1: "worker.coresUsed",
        5: "master.aliveWorkers",
        9: "worker.memUsed_MB",
        2: "worker.coresFree",
        6: "master.workers",
        10: "worker.memFree_MB",
    }
    gauge = (
        F.when(
            (kind == "click") & (number % 3 == 0),
            F.concat(owned, F.lit(".ExecutorMetrics.JVMHeapMemory")),
        )
        .when((kind == "click") & (number % 3 == 1), F.concat(owned, F.lit(".JVMCPU.jvmCpuTime")))
        .when(kind == "click", F.concat(owned, F.lit(".ExecutorMetrics.MajorGCTime")))
        .when(kind == "purchase", F.concat(app, F.lit(".driver.DAGScheduler.job.activeJobs")))
        .when(number % 12 == 0, F.concat(user_app, F.lit(".cores")))
        .when(number % 12 == 4, F.concat(user_app, F.lit(".runtime_ms")))
        .when(number % 12 == 8, F.concat(user_app, F.lit(".status")))
    )
    for rest, name in node_names.items():
        gauge = gauge.when(number % 12 == rest, name)
    is_status = (kind == "error") & (number % 12 == 8)
    status = F.when(is_status, F.when(F.col("v") % 2 == 0, "RUNNING").otherwise("FINISHED"))
    gauges = events.filter(~counts_up).select(
        *_sample(
            gauge.otherwise("nodots"),
            "gauges",
            "Value",
            F.when(~is_status, F.col("v")),
            status,
        )
    )
    return gauges.unionByName(counters)


@landed
def repeated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge and counter readings as they arrive, every tenth a second time and one higher."""
    events = _events(spark, sf_dir)
    name = F.concat("app", F.lit("."), "owner", F.lit(".ExecutorMetrics.JVMHeapMemory"))
    first = events.select(
        "event_id", *_sample(name, "gauges", "Value", F.col("v"), F.lit(None))
    )
    again = (
        first.filter(F.col("event_id") % 10 == 0)
        .withColumn("arrival", F.lit(2))
        .withColumn("value", F.col("value") + 1)
    )
    return first.unionByName(again).drop("event_id")


@cache
def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(name) for name in METRIC_SETS))
    return table(spark, sf_dir, "events").select(
        utc("ts").alias("ts"),
        F.concat(F.lit("h-"), F.col("user_id") % 10).alias("host"),
        F.get(names, (F.col("event_id") % 12).cast("int")).alias("metricset"),
        F.create_map(F.lit("value"), F.col("value")).alias("metrics"),
    )


# --- log lines and nodes ----------------------------------------------------------

LINES_PER_BLOCK = 64


@landed
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, every fourth with a time in front; a document is a file."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value")
    )
    starts = (F.col("doc_id") + F.col("line")) % 4 == 0
    return lines.select(
        F.col("doc_id").cast("string").alias("file"),
        F.floor(F.col("line") / LINES_PER_BLOCK).alias("block"),
        F.col("line").cast("bigint").alias("pos"),
        F.when(starts, F.concat(F.lit("24/01/02 03:04:05 INFO "), F.col("value")))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def log_path() -> Column:
    """Where a document's file lies: odd ids are driver logs."""
    number = F.col("file").cast("bigint")
    return F.when(
        number % 2 == 1, F.concat(F.lit("/logs/driver/logs/stdout-"), "file")
    ).otherwise(F.concat(F.lit("/logs/spark/work/app-0/1/stderr-"), "file"))


@cache
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    flag = (
        F.when(key % 10 == 9, F.lit(None))
        .when(key % 10 == 7, "true")
        .when(key % 4 == 0, "TRUE")
        .otherwise("FALSE")
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("h-"), key).alias("host"),
        flag.alias("is_driver"),
        F.concat(F.lit("c-"), key % 10).alias("cluster_id"),
        F.concat(F.lit("10.0.0."), key % 250).alias("container_ip"),
        F.concat(F.lit("type-"), F.col("s_nationkey") % 3).alias("instance_type"),
        F.col("s_name").alias("cluster_name"),
        F.when(F.col("s_nationkey") % 2 == 0, "TRUE").otherwise("FALSE").alias("is_job_cluster"),
    )


#: hosts change their cluster at this time, those of even number twice
MOVED = "timestamp'2024-01-16 00:00:00+00:00'"


@cache
def moving_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes as they were seen: in another cluster first, and once more unchanged; those of
    even number come back to it ten days after they left."""
    known = nodes(spark, sf_dir)
    early = known.withColumn("cluster_id", F.lit("c-old"))
    back = F.expr(f"pmod(bigint(substr(host, 3)), 2) = 0")
    seen = [
        (early, F.lit(None).cast("timestamp")),
        (early, F.expr(f"{MOVED} - INTERVAL 3 DAYS")),
        (known, F.expr(MOVED)),
        (early.filter(back), F.expr(f"{MOVED} + INTERVAL 10 DAYS")),
    ]
    parts = [rows.withColumn("seen_at", at) for rows, at in seen]
    return reduce(DataFrame.unionByName, parts)

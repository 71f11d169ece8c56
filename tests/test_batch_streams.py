"""Streams kept up to date batch by batch: late, changed, wrong and repeated rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.job_events import job_events
from tidewatch.schema.source_types import JMX_SAMPLE, RUN_PAGE
from tidewatch.sinks import stream_tables
from tidewatch.sinks.batch_tables import FOLDER, BatchTables, folder_of
from tidewatch.streaming.job_runs import JobEventFeed, StatusCounts, status_counts
from tidewatch.streaming.metrics import GaugeRollups, rollup_once
from tidewatch.streaming.runs import run_batches

NOW = datetime(2024, 5, 2, tzinfo=timezone.utc)
PAGES = f"{RUN_PAGE}, poll int"


def ms(*when) -> int:
    return int(datetime(*when, tzinfo=timezone.utc).timestamp() * 1000)


def run(spark, rows):
    """Pages of one run each from (run, start, state, result, poll)."""
    kinds = "id bigint, start bigint, state string, result string, poll int"
    df = spark.createDataFrame(rows, kinds)
    one = spark.createDataFrame([], PAGES).schema["runs"].dataType.elementType
    made = {
        "job_run_id": F.col("id"),
        "start_time": F.col("start"),
        "end_time": F.when(F.col("state") == "TERMINATED", F.col("start") + 1000),
        "state": F.struct(
            F.lit(None).cast("string").alias("life_cycle_state"), F.col("result").alias("result_state"),
            F.lit(None).cast("string").alias("state_message"),
            F.lit(None).cast("boolean").alias("user_cancelled_or_timedout"),
        ),
        "status": F.struct(F.col("state").alias("state"), F.lit(None).cast("struct<code: string, type: string>").alias("termination_details")),
    }
    fields = [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in one.fields]
    return df.select(
        F.lit("p").alias("page_token"),
        F.lit("").alias("next_page_token"),
        F.array(F.struct(*fields)).alias("runs"),
        "poll",
    )


def counted(df):
    return {(r.bucket.isoformat(), r.result_state): r.n_runs for r in df.collect()}


DONE = "TERMINATED"


def test_a_run_dated_far_ahead_does_not_make_others_late(spark, tmp_path):
    """Three ended runs of a day in three files, one dated 2100 in the first."""
    landing = str(tmp_path / "in")
    counts = StatusCounts(spark, str(tmp_path / "counts"))
    files = [
        [(1, ms(2024, 5, 1), DONE, "SUCCESS", 1), (9, ms(2100, 1, 1), DONE, "SUCCESS", 1)],
        [(2, ms(2024, 5, 1), DONE, "SUCCESS", 2)],
        [(3, ms(2024, 5, 1), DONE, "SUCCESS", 3)],
    ]
    for rows in files:
        pages = run(spark, rows)
        pages.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(pages.schema).parquet(landing)
        run_batches(stream, counts.apply, str(tmp_path / "state"))
    assert counted(counts.counts()) == {
        ("2024-05-01T00:00:00", "SUCCESS"): 3,
        ("2100-01-01T00:00:00", "SUCCESS"): 1,
    }


def test_counts_equal_the_batch_result_at_every_step(spark, tmp_path):
    pick = random.Random(3)
    counts = StatusCounts(spark, str(tmp_path / "counts"), every="12h")
    landed = None
    for batch in range(5):
        rows = []
        for _ in range(60):
            start = pick.choice([None, 0, ms(2024, 5, 1, pick.randrange(24)), ms(2100, 1, 1), ms(1990, 1, 1)])
            state = pick.choice([DONE, "RUNNING", None])
            result = pick.choice(["SUCCESS", "FAILED", None])
            rows.append((pick.choice([None, *range(25)]), start, state, result, pick.randrange(9)))
        pages = run(spark, rows)
        landed = pages if landed is None else landed.unionByName(pages)
        assert counts.apply(pages, batch)
        assert not counts.apply(pages, batch)  # comes again
        if batch == 3:
            counts.fold()
        assert counted(counts.counts()) == counted(status_counts(landed, every="12h"))


def test_a_batch_that_failed_half_way_counts_once(spark, tmp_path, monkeypatch):
    counts = StatusCounts(spark, str(tmp_path / "counts"))
    pages = run(spark, [(i, ms(2024, 5, 1), DONE, "SUCCESS", 1) for i in range(7)])
    write = BatchTables.write

    def failing(self, name, *rest, **more):
        if name == "deltas":
            raise RuntimeError("lost")
        return write(self, name, *rest, **more)

    monkeypatch.setattr(BatchTables, "write", failing)
    with pytest.raises(RuntimeError):
        counts.apply(pages, 0)
    assert counts.counts().count() == 0
    monkeypatch.undo()
    assert counts.apply(pages, 0)
    assert counted(counts.counts()) == {("2024-05-01T00:00:00", "SUCCESS"): 7}


def feed_events(spark, feed, pages):
    schema = job_events(pages, NOW, "https://x").schema
    rows = feed.events(schema).select("job.job_run_id", "job.status.state").collect()
    return sorted((r.job_run_id or "", r.state) for r in rows)


def test_a_rerun_adds_no_ended_run(spark, tmp_path):
    feed = JobEventFeed(spark, str(tmp_path / "feed"))
    now = ms(2024, 5, 2)
    first = run(spark, [(1, now, DONE, "SUCCESS", 1), (2, now, "RUNNING", None, 1), (None, now, DONE, None, 1)])
    again = run(spark, [(1, now, DONE, "SUCCESS", 2), (2, now, DONE, "FAILED", 2), (3, now, "RUNNING", None, 2)])
    assert feed.apply(first, 0, NOW, "https://x")
    assert feed_events(spark, feed, first) == [("", DONE), ("1", DONE), ("2", "RUNNING")]
    assert not feed.apply(first, 0, NOW, "https://x")
    assert feed.apply(again, 1, NOW, "https://x")
    feed.fold()
    assert feed.apply(again, 2, NOW, "https://x")  # the same pages, fetched anew
    assert feed_events(spark, feed, first) == [
        ("", DONE), ("1", DONE), ("2", "RUNNING"), ("2", DONE), ("3", "RUNNING"), ("3", "RUNNING"),
    ]


def test_keys_are_looked_up_in_their_own_folders_only(spark, tmp_path):
    feed = JobEventFeed(spark, str(tmp_path / "feed"))
    start = ms(2024, 5, 2)
    feed.apply(run(spark, [(i, start, DONE, None, 1) for i in range(300)]), 0, NOW, "https://x")
    one = spark.range(1).select(folder_of("id")).first()[0]
    seen = feed.tables.read("seen", feed.SEEN, [one])
    read = {path.split(f"{FOLDER}=")[1].split("/")[0] for path in seen.inputFiles()}
    assert len(read) > 30  # all are listed
    scan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in scan or "folder#" in scan.split("PartitionFilters")[1]


def rolled(df):
    return sorted((tuple(r) for r in df.select(
        "bucket", "host", "mbean", "stream", "field", "min_value", "max_value", "avg_value", "last_value", "n_samples"
    ).collect()), key=str)


def test_late_and_repeated_samples(spark, tmp_path):
    pick = random.Random(5)
    start = datetime(2024, 1, 1)
    rollups = GaugeRollups(spark, str(tmp_path / "rollups"), every="5m")
    landed = None
    mbean = "metrics:name=app.1.ExecutorMetrics.JVMHeapMemory,type=gauges"
    for batch in range(4):
        rows = []
        for _ in range(80):
            at = start + timedelta(days=pick.randrange(3), minutes=pick.randrange(30))
            host, value = pick.choice(["a", "b", None]), float(pick.randrange(50))
            rows.append((at, pick.randrange(4), host, mbean, "Value", value, None))
        rows += [(None, 1, "a", mbean, "Value", 1.0, None), (start, 1, "a", None, "Value", 1.0, None)]
        samples = spark.createDataFrame(rows, JMX_SAMPLE)
        landed = samples if landed is None else landed.unionByName(samples)
        rollups.apply(samples, batch)
        rollups.apply(samples, batch)
        assert rolled(rollups.rollup()) == rolled(rollup_once(landed, "5m"))
    once = rollups.samples()
    assert once.count() == landed.filter("ts IS NOT NULL").select("ts", "host", "mbean", "attribute").distinct().count()


def test_a_routed_batch_that_comes_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "set string, v int")
    rows = stream_tables.to_stream(rows, "metrics", F.concat(F.lit("system."), "set"), "ns")
    landing, root = str(tmp_path / "in"), str(tmp_path / "tables")
    for _ in range(2):
        rows.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        stream_tables.route_stream(stream, root, str(tmp_path / "state"))
    for batch in (1, 1):
        stream_tables.route_batch(rows, root, batch)
    counts = stream_tables.stream_table_counts(stream_tables.read_stream_tables(spark, root))
    assert {tuple(r) for r in counts.collect()} == {("metrics-system.a-ns", 4), ("metrics-system.b-ns", 2)}

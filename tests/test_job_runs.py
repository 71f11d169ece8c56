"""Edge cases of the job-run steps."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import job_runs as jobs
from tidewatch.operators import sequences
from tidewatch.plans.job_events import job_events, job_events_from_text
from tidewatch.schema.source_types import RUN_PAGE, RUN_TASK
from tidewatch.sources.run_pages import (
    lookback_filter,
    page_chain_audit,
    read_run_pages,
    require_complete_chain,
)

NOW = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
NOW_MS = 1_704_110_400_000


def job_rows(spark, *jobs_):
    schema = f"n int, job {RUN_TASK}"
    lines = [json.dumps({"n": n, "job": job}) for n, job in enumerate(jobs_)]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    return df.select(F.from_json("line", schema).alias("r")).select("r.*")


def values(df, column):
    return [r[0] for r in df.orderBy("n").select(column).collect()]


TASK = {"run_id": 1}


def test_split_keeps_runs_without_tasks(spark):
    page = {
        "page_token": "p0",
        "runs": [
            {"job_run_id": 1, "tasks": [{"run_id": 11}, {"run_id": 12}]},
            {"job_run_id": 2, "tasks": []},
            {"job_run_id": 3},
        ],
    }
    df = spark.createDataFrame([(json.dumps(page),)], "line string")
    pages = df.select(F.from_json("line", RUN_PAGE).alias("p")).select("p.*")
    rows = jobs.split_tasks(jobs.split_runs(pages))
    found = rows.select("job_run_id", "tasks.run_id").orderBy("job_run_id", "run_id").collect()
    assert [tuple(r) for r in found] == [(1, 11), (1, 12), (2, None), (3, None)]


def test_flag_and_drop(spark):
    edge = NOW_MS - 300_000
    done = {"state": "TERMINATED"}
    rows = job_rows(
        spark,
        {"end_time": edge, "tasks": TASK, "status": done},
        {"end_time": edge - 1, "tasks": TASK, "status": done},
        {"tasks": TASK, "status": done},
        {"end_time": edge - 1, "status": done},
        {"end_time": edge - 1, "tasks": TASK, "status": {"state": "RUNNING"}},
        {"end_time": edge - 1, "tasks": TASK},
    )
    flagged = jobs.flag_in_interval(rows, NOW, "5m")
    assert values(flagged, jobs.FLAG) == [True, False, False, None, False, False]
    assert values(jobs.drop_stale(flagged), "n") == [0, 3, 4, 5]


def test_times_and_duration(spark):
    rows = job_rows(
        spark,
        {"start_time": 1000, "end_time": 4500, "run_duration": 9},
        {"start_time": 0, "end_time": 4500, "run_duration": 9},
        {"start_time": 1000, "end_time": 0, "run_duration": 9},
        {"start_time": 1000, "run_duration": 9},
        {"end_time": 4500, "run_duration": 9},
        {"start_time": -1, "end_time": 9223372036854775807, "run_duration": 9},
    )
    rows = jobs.ms_to_time(jobs.run_duration(rows))
    assert values(rows, "job.run_duration") == [3500, 4500, 9, 9, 9, 9]
    starts = rows.withColumn("s", F.unix_millis("job.start_time"))
    assert values(starts, "s") == [1000, None, 1000, 1000, None, None]
    ends = rows.withColumn("e", F.unix_millis("job.end_time"))
    assert values(ends, "e")[:5] == [4500, 4500, None, None, 4500]


def test_duration_in_ns(spark):
    rows = job_rows(
        spark,
        *({"run_duration": d} for d in (5, 0, -5, None, 9223372036854775807)),
    )
    assert values(jobs.event_duration(rows), "event_duration") == [5_000_000] + [None] * 4


def test_cluster_id(spark):
    at = lambda c: {"cluster_instance": {"cluster_id": c}}
    rows = job_rows(
        spark, {**at("a"), "tasks": at("b")}, {"tasks": at("b")}, {**at(""), "tasks": at("b")}, {}
    )
    assert values(jobs.cluster_id(rows), "cluster_id") == ["a", "b", "", "Serverless"]


def test_outcome(spark):
    states = ("SUCCESS", "FAILED", "CANCELED", "TIMEDOUT", None, "success")
    rows = job_rows(spark, *({"state": {"result_state": s}} for s in states))
    assert values(jobs.outcome(rows), "event_outcome") == [
        "success",
        "failure",
        "unknown",
        None,
        None,
        None,
    ]


def test_last_cloud_match_wins(spark):
    hosts = {
        "https://adb-1.azuredatabricks.net": "azure",
        "https://x.cloud.databricks.com": "aws",
        "https://1.gcp.databricks.com": "gcp",
        "https://azuredatabricks.net.cloud.databricks.com": "aws",
        "https://cloud.databricks.com.gcp.databricks.com": "gcp",
        "https://elsewhere.example": None,
    }
    df = spark.createDataFrame(list(enumerate(hosts)), "n int, host string")
    found = values(jobs.cloud_provider(df, F.col("host")), "cloud_provider")
    assert found == list(hosts.values())
    assert values(jobs.cloud_provider(df, "x.gcp.databricks.com"), "cloud_provider") == ["gcp"] * 6


def test_related_user(spark):
    rows = job_rows(spark, *({"creator_user_name": u} for u in ("a", "b", None, "a")))
    before = F.when(F.col("n") < 3, F.array(F.lit("a")))
    grown = jobs.related_user(rows.withColumn("related_user", before))
    assert values(grown, "related_user") == [["a"], ["a", "b"], ["a"], ["a"]]


def test_tags_and_original(spark):
    rows = job_rows(spark, {}).withColumn("event_original", F.lit("x"))
    kept = jobs.apply_tags(rows, ["t"], preserve_original=True)
    assert values(kept, "tags") == [["preserve_original_event", "t"]]
    assert values(jobs.retain_original(kept), "event_original") == ["x"]
    assert values(jobs.apply_tags(rows), "tags") == [None]
    for tags in ((), ("t",)):
        assert values(jobs.retain_original(jobs.apply_tags(rows, tags)), "event_original") == [None]


def test_decode_json(spark):
    texts = [
        '{"job_run_id": 1, "state": {"result_state": "SUCCESS"}, "tasks": {"run_id": 5}}',
        '{"job_run_id": 2, "state": "{\\"result_state\\": \\"FAILED\\"}"}',
        '{"job_run_id": 3',
        "[1, 2]",
        "7",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, message string")
    decoded = jobs.decode_json(df)
    assert values(decoded, "job.job_run_id") == [1, 2] + [None] * 5
    assert values(decoded, "job.state.result_state")[:2] == ["SUCCESS", "FAILED"]
    assert values(decoded, "job.tasks.run_id")[0] == 5
    failed = [e is not None for e in values(decoded, "decode_error")]
    assert failed == [False, False, True, True, True, True, False]


def test_decode_json_keeps_what_is_there(spark):
    df = job_rows(spark, {"job_run_id": 1}).withColumn("message", F.lit('{"job_run_id": 9}'))
    assert values(jobs.decode_json(df), "job.job_run_id") == [1]


def test_errors_are_not_overwritten(spark):
    df = spark.createDataFrame(
        [(0, None, "bad"), (1, "first", "bad"), (2, None, None)],
        "n int, error_message string, reason string",
    )
    found = values(jobs.capture_error(df, "reason"), "error_message")
    assert found == ["Pipeline processing failed: bad", "first", None]


def test_dedup_keeps_the_first_poll_and_open_runs(spark):
    done, open_ = {"state": "TERMINATED"}, {"state": "RUNNING"}
    run = lambda i, t, s: {"job_run_id": i, "tasks": {"run_id": t}, "status": s}
    rows = job_rows(
        spark,
        run(1, 1, done), run(1, 1, done), run(1, 2, done), run(2, 1, open_), run(2, 1, open_),
        {"job_run_id": 3, "status": done}, {"job_run_id": 3, "status": done}, {},
    ).withColumn("poll", 9 - F.col("n"))
    once = jobs.dedup_terminated(rows)
    assert values(once, "n") == [1, 2, 3, 4, 6, 7]
    assert values(jobs.dedup_terminated(once), "n") == [1, 2, 3, 4, 6, 7]


def test_counted_copies_are_dealt_unless_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(sequences.dealt, "__defaults__", (5,))
    done = {"state": "TERMINATED"}
    few = [{"job_run_id": i % 30, "tasks": {"run_id": 1}, "status": done} for i in range(40)]
    few += [{"job_run_id": 1, "status": {"state": "RUNNING"}}] * 3 + [{}]
    many = [{"job_run_id": i % 10, "status": done} for i in range(40)]
    for runs, number, is_dealt in ((few, 34, True), (many, 10, False)):
        rows = job_rows(spark, *runs).withColumn("poll", -F.col("n"))
        once = jobs.dedup_terminated(rows, counted=True)
        assert ("REPARTITION_BY_NUM" in once._jdf.queryExecution().executedPlan().toString()) == is_dealt
        assert values(once, "n") == values(jobs.dedup_terminated(rows), "n")
        assert once.count() == number and once.columns == rows.columns


def test_lookback_and_chain(spark, tmp_path):
    pages = [
        {"page_token": "a", "next_page_token": "b", "runs": [{"start_time": NOW_MS - 18_000_000}]},
        {"page_token": "b", "next_page_token": "c", "runs": [{"start_time": NOW_MS - 18_000_001}]},
    ]
    (tmp_path / "page.json").write_text("\n".join(map(json.dumps, pages)))
    read = read_run_pages(spark, str(tmp_path))
    assert lookback_filter(jobs.split_runs(read), NOW, "5h").count() == 1
    missing = page_chain_audit(read).collect()
    assert [tuple(r) for r in missing] == [("c", 1, "b")]
    with pytest.raises(ValueError, match="'c'"):
        require_complete_chain(read)


def test_text_and_pages_give_the_same_events(spark):
    tasks = [{"run_id": 11, "execution_duration": 5}, {"run_id": 12}]
    run = {
        "job_run_id": 1, "job_id": 4, "start_time": NOW_MS - 60_000, "end_time": NOW_MS - 1000,
        "creator_user_name": "u", "state": {"result_state": "FAILED"},
        "status": {"state": "TERMINATED"}, "tasks": tasks,
    }
    df = spark.createDataFrame([(json.dumps({"runs": [run]}),)], "line string")
    pages = df.select(F.from_json("line", RUN_PAGE).alias("p")).select("p.*", F.lit(1).alias("poll"))
    host = "https://x.cloud.databricks.com"
    by_page = job_events(pages, NOW, host)
    texts = [(json.dumps({**run, "tasks": task}),) for task in tasks]
    messages = spark.createDataFrame(texts, "message string").withColumn("poll", F.lit(1))
    by_text = job_events_from_text(messages, NOW, host).drop("event_original")
    order = "job.tasks.run_id"
    assert by_page.orderBy(order).collect() == by_text.orderBy(order).collect()
    row = by_page.orderBy(order).first()
    assert row.event.duration == 59_000_000_000 and row.event.outcome == "failure"
    assert row.cloud.provider == "aws" and row.related.user == ["u"] and row["@timestamp"]
    assert row.event.id == "1" and row.user.name == "u" and row.job.tasks.run_id == "11"

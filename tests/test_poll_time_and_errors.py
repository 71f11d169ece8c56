from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.functions.durations import cutoff_ms
from tidewatch.operators import job_runs as steps
from tidewatch.operators.log_events import multiline
from tidewatch.operators.metrics import tsds_dedup
from tidewatch.operators.nodes import add_node_facts
from tidewatch.plans.job_events import job_events, run_task_rows
from tidewatch.schema.source_types import LOG_LINE, NODE
from tidewatch.sources.run_pages import read_run_pages
from tidewatch.streaming.log_events import fold_lines

NOW = datetime(2001, 8, 2, tzinfo=timezone.utc)
NOW_MS = int(NOW.timestamp() * 1000)
PAGE = '{"page_token": "p1", "runs": [{"job_run_id": %s, "job_id": %s, "start_time": %d}]}'


def landed(spark, tmp_path, *lines):
    (tmp_path / "pages.json").write_text("\n".join(lines))
    return read_run_pages(spark, str(tmp_path))


def test_pages_that_cannot_be_read_end_as_error_rows(spark, tmp_path):
    pages = landed(spark, tmp_path, PAGE % (1, 7, NOW_MS), "{broken", PAGE % (2, '"abc"', NOW_MS))
    events = job_events(pages, NOW, "https://x", poll=None)
    rows = {r["id"]: r["error_message"] for r in events.select(F.col("job.job_run_id").alias("id"), "error_message").collect()}
    assert len(rows) >= 2
    assert rows["1"] is None
    assert all(m for i, m in rows.items() if i != "1")
    assert events.count() == 3


def test_an_old_run_is_left_out_but_an_unread_page_is_not(spark, tmp_path):
    pages = landed(spark, tmp_path, PAGE % (1, 7, 0), "{oops")
    assert run_task_rows(pages, NOW).select("job.job_run_id", "decode_error").collect()[0]["job_run_id"] is None


def test_unread_nested_text_is_told(spark):
    rows = [('{"run_id": 1, "state": "not json"}',), ('{"run_id": 2, "state": {"result_state": "SUCCESS"}}',), ("{",), ('{"run_id": 3}',)]
    out = steps.decode_json(spark.createDataFrame(rows, "message string")).select(
        "job.run_id", "job.state.result_state", "decode_error"
    )
    got = [tuple(r) for r in out.collect()]
    assert got[0] == (1, None, "state of message cannot be read")
    assert got[1] == (2, "SUCCESS", None)
    assert got[2][0] is None and got[2][2] == "message is not a JSON object"
    assert got[3] == (3, None, None)


def test_runs_are_told_by_run_id_and_pass_without_one(spark):
    kinds = "job struct<job_run_id bigint, run_id bigint, status struct<state string>, tasks struct<run_id bigint>>, poll int"
    done = ("TERMINATED",)
    rows = [((None, i, done, None), p) for i in (1, 2, 3) for p in (2, 1)]
    rows += [((None, None, done, None), p) for p in (1, 2)] + [((5, 5, ("RUNNING",), None), p) for p in (1, 2)]
    out = steps.dedup_terminated(spark.createDataFrame(rows, kinds)).select("job.run_id", "poll").collect()
    assert sorted((r["run_id"] or 0, r["poll"]) for r in out) == [(0, 1), (0, 2), (1, 1), (2, 1), (3, 1), (5, 1), (5, 2)]


def test_dedup_reads_its_input_once(spark, tmp_path):
    spark.range(10).selectExpr(
        "named_struct('job_run_id', id, 'run_id', id, 'status', named_struct('state', 'TERMINATED'), "
        "'tasks', named_struct('run_id', id)) AS job", "1 AS poll"
    ).write.parquet(str(tmp_path / "runs"))
    once = steps.dedup_terminated(spark.read.parquet(str(tmp_path / "runs")))
    plan = once._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1


def test_each_page_has_its_own_time(spark):
    later = datetime(2001, 8, 3, tzinfo=timezone.utc)
    times = spark.createDataFrame([(NOW,), (later,)], "t timestamp").select(cutoff_ms(F.col("t"), "5m").alias("ms"))
    assert [r["ms"] for r in times.collect()] == [cutoff_ms(NOW, "5m"), cutoff_ms(later, "5m")]


def test_streams_and_attributes_are_dimensions(spark):
    kinds = "ts int, host string, mbean string, stream string, field string, attribute string, arrival int"
    rows = [(1, "h", "m", s, "f", a, n) for s in ("driver", "executor") for a in ("Value", "Count") for n in (2, 1)]
    out = tsds_dedup(spark.createDataFrame(rows, kinds)).collect()
    assert len(out) == 4 and {r["arrival"] for r in out} == {1}


def test_a_host_in_two_clusters_does_not_double_rows(spark):
    nodes = spark.createDataFrame(
        [("h", "TRUE", f"c{i}", None, None, None, None, i) for i in (1, 3, 2)], f"{NODE}, seen_at int"
    )
    rows = spark.createDataFrame([("h", 1), ("g", 2)], "host string, v int")
    out = {r["host"]: (r["node_role"], r["cluster_id"]) for r in add_node_facts(rows, nodes).collect()}
    assert out == {"h": ("Driver", "c3"), "g": ("Executor", None)}


def test_only_ascii_digits_open_an_event(spark):
    import pandas as pd

    pattern = r"^\d{2}/\d{2}"
    texts = ["24/01 a", "٢٤/٠١ b"]
    rows = [("f", 0, i, t) for i, t in enumerate(texts)]
    lines = pd.DataFrame(rows, columns=["file", "block", "pos", "value"])
    assert fold_lines(lines, pattern, True, 10)["opens"].tolist() == [True]
    assert multiline(spark.createDataFrame(rows, LOG_LINE), pattern).count() == 1


def test_no_line_is_cut_unless_asked(spark):
    rows = [("f", 0, i, "24/01/02 03:04:05 x" if i == 0 else "y") for i in range(1500)]
    row = multiline(spark.createDataFrame(rows, LOG_LINE)).first()
    assert (row["n_lines"], row["truncated"], row["message"].count("\n")) == (1500, False, 1499)

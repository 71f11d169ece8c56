"""Pages landed as text, and events of pages as they come: what is written and what is joined."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from checks import inputs, queries
from tidewatch.schema.source_types import RUN_PAGE
from tidewatch.sinks.batch_tables import BatchTables
from tidewatch.streaming.job_runs import JobEventFeed


def pages(spark, *runs):
    rows = spark.createDataFrame([(f"p{n}", r) for n, r in enumerate(runs)], "page_token string, r string")
    text = F.concat(F.lit('{"page_token": "'), "page_token", F.lit('", "next_page_token": "", "runs": ['), "r", F.lit("]}"))
    return rows.select(F.from_json(text, RUN_PAGE).alias("p")).select("p.*")


RUN = '{"job_run_id": %d, "start_time": 9, "status": {"state": "%s"}, "tasks": [{"run_id": 1}]}'


def test_pages_are_landed_compressed_in_small_files(spark, tmp_path, monkeypatch):
    given = pages(spark, *(RUN % (n, "RUNNING") for n in range(8))).coalesce(1)
    monkeypatch.setattr(inputs, "run_pages", lambda spark, sf_dir: given)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(queries, "PAGES_PER_FILE", 4, raising=False)
    found = queries.queries()["run_pages_scan"](spark, "").select("failed", "page_token").collect()
    assert sorted(r[0] for r in found) == [False] * 8 + [True] * 2
    assert {r[1] for r in found} == {None, *(f"p{n}" for n in range(8))}
    files = list(Path(tmp_path / "run-pages").glob("part-*"))
    assert len(files) >= 3 and all(f.suffix == ".gz" for f in files)


def test_rows_without_a_key_stay_out_of_the_join(spark, tmp_path, monkeypatch):
    plans = {}
    write = BatchTables.write

    def noted(self, name, batch, rows, by=()):
        plans[name, batch] = rows._jdf.queryExecution().optimizedPlan().toString()
        return write(self, name, batch, rows, by)

    monkeypatch.setattr(BatchTables, "write", noted)
    feed = JobEventFeed(spark, str(tmp_path / "events"))
    now = F.lit(inputs.NOW)
    poll = pages(spark, RUN % (1, "TERMINATED"), RUN % (2, "RUNNING"), RUN % (3, "RUNNING"))
    for batch in (0, 1):
        feed.apply(poll.withColumn("poll", F.lit(batch)), batch, now, "https://x", "900000h", "900000h")
    lines = plans["events", 1].splitlines()
    at = next(n for n, line in enumerate(lines) if "Join LeftAnti" in line)
    assert any("isnotnull(_run" in line for line in lines[at + 1 : at + 4])
    runs = spark.read.parquet(str(tmp_path / "events" / "events")).select("job.job_run_id")
    assert sorted(r[0] for r in runs.collect()) == ["1", "2", "2", "3", "3"]

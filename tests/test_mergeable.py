"""What merges: day tables of runs, rollups of rollups; and page chains on a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rollups, series
from tidewatch.plans import dashboards, run_days
from tidewatch.streaming.page_chains import stream_chain_audit
from tidewatch.streaming.runs import run_available

EVENTS = (
    "job_job_run_id string, job_state_result_state string, job_start_time timestamp, "
    "job_run_name string, job_job_id string, databricks_cluster_id string"
)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_day_tables_of_overlapping_parts_count_each_run_once(spark):
    pick = random.Random(2)
    runs = [
        (
            pick.choice([None, str(i), str(-i), str(i * 10**12)]),
            pick.choice(["SUCCESS", "FAILED", "CANCELED", "TIMEDOUT", None]),
            pick.choice([None, datetime(2024, 1, 1 + i % 9, i % 24)]),
            f"n{i % 3}",
            pick.choice([None, str(i % 5)]),
            f"c{i % 2}",
        )
        for i in range(120)
    ]
    parts = [spark.createDataFrame(pick.sample(runs, 70) * 2, EVENTS) for _ in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    days = [run_days.run_days(p) for p in parts]
    days = run_days.merge_days(days[0].unionByName(days[1]).unionByName(days[2]))
    assert rows_of(run_days.totals_of_days(days)) == rows_of(dashboards.run_totals(whole))
    for every in ("24h", "72h"):
        timed = dashboards.runs_timeline(whole.filter("job_job_run_id IS NOT NULL"), every)
        assert rows_of(run_days.timeline_of_days(days, every)) == rows_of(timed)
    options = dashboards.control_options(whole.filter("job_job_run_id IS NOT NULL")).filter("control <> 'job_run_id'")
    assert rows_of(run_days.options_of_days(days)) == rows_of(options)
    none = run_days.run_days(parts[0].limit(0))
    assert tuple(run_days.totals_of_days(none).first()) == (0, 0, 0, 0)


def test_hours_from_minutes_equal_hours_from_samples(spark, tmp_path):
    pick = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [
        (start + timedelta(seconds=i * 17), pick.choice(["a", None]), "m", "s", "f", pick.choice([None, float(i % 13)]))
        for i in range(900)
    ]
    pick.shuffle(rows)
    kinds = "ts timestamp, host string, mbean string, stream string, field string, value double"
    levels = rollups.RollupLevels(spark, str(tmp_path), ("1m", "1h", "3h"))
    for batch in range(3):
        part = spark.createDataFrame(rows[batch::3], kinds)
        assert levels.apply(part, batch) and not levels.apply(part, batch)
        if batch == 1:
            levels.fold()
    whole = spark.createDataFrame(rows, kinds)
    for width in ("1m", "1h", "3h"):
        want = series.gauge_rollup(whole, every=width)
        if width == "1m":  # of a minute without any value there is no last one
            want = want.withColumn("last_value", F.when(F.col("n_samples") > 0, F.col("last_value")))
        last = rows_of(levels.rollup(width).drop("last_value"))
        assert last == rows_of(want.drop("last_value"))
        found = {r[:5]: r.last_value for r in levels.rollup(width).select("bucket", "host", "mbean", "stream", "field", "last_value").collect()}
        for (bucket, host, *_), value in found.items():
            step = timedelta(minutes={"1m": 1, "1h": 60, "3h": 180}[width])
            inside = [r for r in rows if bucket <= r[0] < bucket + step and r[1] == host and r[5] is not None]
            assert value == (max(inside)[5] if inside else None)
    with pytest.raises(ValueError):
        rollups.RollupLevels(spark, str(tmp_path), ("1m", "90s"))


def test_a_page_missing_for_longer_than_the_bound_is_told_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda minutes: start + timedelta(minutes=minutes)
    goes = [
        [("a", "b", at(0)), ("b", "late", at(1)), ("x", "gone", at(2)), ("y", "gone", at(2))],
        [("late", "", at(50)), ("early", "", at(51)), ("z", "early", at(55))],
        [("far", "", at(600))],
        [("farther", "", at(1200))],
        [("farthest", "", at(1800))],
    ]
    for rows in goes:
        kinds = "page_token string, next_page_token string, fetched_at timestamp"
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(kinds).parquet(landing)
        run_available(stream_chain_audit(stream, within="1h", late="1h"), out, state)
    found = spark.read.parquet(out).collect()
    assert [r.missing_token for r in found] == ["gone"]

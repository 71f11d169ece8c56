"""Edge cases of the metric steps, and properties of the series steps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import metrics, sequences, series
from tidewatch.plans import panels
from tidewatch.plans.metric_events import metric_events, wide_table
from tidewatch.schema.metric_leaves import mapped_leaves
from tidewatch.schema.source_types import JMX_SAMPLE

T0 = datetime(2024, 1, 1)


def sample(name, kind="gauges", value=1.0, second=0, attribute=None, status=None, host="h"):
    attribute = attribute or ("Value" if kind == "gauges" else "Count")
    mbean = f"metrics:name={name},type={kind}"
    return (T0 + timedelta(seconds=second), 1, host, mbean, attribute, value, status)


def samples(spark, *rows):
    return spark.createDataFrame(list(rows), JMX_SAMPLE)


def test_every_pattern_matches_its_own_names(spark):
    rows = []
    for leaf in mapped_leaves():
        name = leaf.pattern.replace("*.*.", "app.1.").replace("*", "any.thing")
        rows.append(sample(name, leaf.bean_type))
    matched = metrics.match_catalogue(samples(spark, *dict.fromkeys(rows)))
    found = {r.field for r in matched.select("field").collect()}
    assert found == {leaf.field for leaf in mapped_leaves()}


def test_matching_is_exact(spark):
    rows = [
        sample("app.driver.ExecutorMetrics.JVMHeapMemory"),
        sample("app.1.ExecutorMetrics.JVMHeapMemory"),
        sample("1.ExecutorMetrics.JVMHeapMemory"),
        sample("master.apps"),
        sample("x.master.apps"),
        sample("application.cores"),
        sample("application..cores"),
        sample("a.driver.spark.streaming.q.latency"),
        sample("a.driver.spark.streaming.latency"),
        sample("a.1.executor.bytesRead", "counters", attribute="Value"),
        sample("a.1.executor.bytesRead", "gauges"),
    ]
    found = metrics.match_catalogue(samples(spark, *rows)).select("mbean", "stream").collect()
    names = sorted((r.mbean.split("name=")[1].split(",")[0], r.stream) for r in found)
    assert names == [
        ("a.driver.spark.streaming.q.latency", "driver"),
        ("app.1.ExecutorMetrics.JVMHeapMemory", "executor"),
        ("app.driver.ExecutorMetrics.JVMHeapMemory", "driver"),
        ("app.driver.ExecutorMetrics.JVMHeapMemory", "executor"),
        ("application..cores", "application"),
        ("master.apps", "node"),
    ]


def test_error_rows_keep_their_payload(spark):
    read = samples(
        spark,
        sample("app.driver.ExecutorMetrics.JVMHeapMemory", value=7.0),
        sample("app.1.ExecutorMetrics.JVMHeapMemory", value=8.0),
    )
    bad, good = metric_events(read, "executor").orderBy(F.col("error_message").isNull()).collect()
    assert bad.error_message and bad.jolokia.value == 7.0
    assert bad.databricks.executor.application_name is None
    assert good.error_message is None and good.jolokia is None
    assert good.databricks.executor.id == "1" and good.databricks.executor.memory.jvm.heap == 8
    assert good.databricks.executor.shuffle.server.used.heap_memory is None


def test_error_message_is_overwritten(spark):
    df = spark.createDataFrame([("old", "new"), ("old", None)], "error_message string, why string")
    assert [r[0] for r in metrics.metric_error(df, "why").collect()] == ["new", "old"]


def test_wide_types(spark):
    read = samples(spark, sample("a.driver.spark.streaming.q.inputRate-total", value=1.5))
    table = wide_table(read, "driver")
    row = table.first()
    assert row.driver_spark_streaming_input_rate_total == 1.5
    assert dict(table.dtypes)["driver_jobs_failed"] == "bigint"
    assert len(table.columns) == 72 + 3


def test_tsds_dedup_treats_null_dimensions_as_equal(spark):
    rows = [(T0, a, None, "m", "Value", float(a), None) for a in (2, 1, 3)]
    once = metrics.tsds_dedup(samples(spark, *rows))
    assert [r.arrival for r in once.collect()] == [1]
    assert metrics.tsds_dedup(once).count() == 1


@pytest.mark.parametrize("slice_seconds", [1, 7, 3600])
def test_counter_deltas(spark, slice_seconds):
    rng = random.Random(5)
    rows, total = [], {}
    for host in ("a", "b", None):
        value = 0
        for second in sorted(rng.sample(range(200), 60)):
            value = 0 if rng.random() < 0.1 else value + rng.randrange(9)
            rows.append((T0 + timedelta(seconds=second), host, float(value)))
    df = spark.createDataFrame(rows, "ts timestamp, host string, value double")
    rated = series.counter_rate(df, ["host"], slice_seconds=slice_seconds)
    window = Window.partitionBy("host").orderBy("ts")
    before, before_ts = F.lag("value").over(window), F.lag("ts").over(window)
    delta = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    passed = (F.unix_micros("ts") - F.unix_micros(before_ts)) / 1e6
    plain = df.withColumn("delta", F.when(before.isNotNull(), delta)).withColumn(
        "rate", F.try_divide("delta", passed)
    )
    order = ["host", "ts"]
    assert rated.select(*plain.columns).orderBy(*order).collect() == plain.orderBy(*order).collect()
    assert rated.filter("delta < 0").count() == 0
    assert total == {}


def test_series_are_read_and_shuffled_once(spark, tmp_path):
    spark.range(100).selectExpr(
        "timestamp_seconds(id * 60) AS ts", "concat('h', id % 3) AS host", "id * 1.0D AS value", "'x' AS note"
    ).write.parquet(str(tmp_path / "samples"))
    df = spark.read.parquet(str(tmp_path / "samples"))
    plan = sequences.in_slices(df, ["host"], "ts", ["ts", "value"], 3600)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    rated = series.counter_rate(df, ["host"])
    assert not any("samples" in f.split("/")[-2] for f in rated.inputFiles())
    plan = rated._jdf.queryExecution().sparkPlan().toString()
    # what is joined or sorted again is one row per slice
    assert plan.count("Join") == 1 and "_starts" in plan.split("Join")[1]


def test_copies_do_not_count_in_panels(spark):
    name = "app.1.executor.bytesRead"
    rows = [sample(name, "counters", float(v), s) for s, v in ((0, 5), (60, 9), (120, 2))]
    again = [(r[0], 2, *r[2:5], r[5] + 100, None) for r in rows for _ in range(3)]
    panel = panels.executor_panel(samples(spark, *rows, *again)).collect()
    assert [(r.increase, r.peak_rate, r.n_samples) for r in panel] == [(6.0, 4 / 60, 3)]
    name = "app.driver.appStatus.jobs.succeededJobs"
    rows = [sample(name, "counters", float(v), s) for s, v in ((0, 5), (60, 9))]
    panel = panels.driver_panel(samples(spark, *rows, *rows, *rows)).collect()
    assert [r.increase for r in panel] == [4.0]


@pytest.mark.parametrize("slice_seconds", [1, 13, 3600])
def test_running_total(spark, slice_seconds):
    rng = random.Random(6)
    rows = [
        (T0 + timedelta(seconds=s), host, rng.randrange(9))
        for host in ("a", "b")
        for s in rng.sample(range(300), 80)
    ]
    df = spark.createDataFrame(rows, "ts timestamp, host string, v bigint")
    mine = sequences.with_running_total(df, ["host"], "ts", "v", "total", slice_seconds)
    window = Window.partitionBy("host").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("total", F.sum("v").over(window))
    order = ["host", "ts"]
    assert mine.select(*plain.columns).orderBy(*order).collect() == plain.orderBy(*order).collect()


def test_sample_gaps(spark):
    rows = [sample("master.apps", second=s) for s in (0, 60, 121, 4000)]
    matched = metrics.match_catalogue(samples(spark, *rows))
    gaps = series.sample_gaps(matched, period="60s", slice_seconds=60).orderBy("gap_start")
    assert [r.gap_seconds for r in gaps.collect()] == [61.0, 3879.0]


def test_override_kind(spark):
    read = samples(spark, sample("app.driver.ExecutorMetrics.JVMHeapMemory"))
    matched = metrics.match_catalogue(read, ["driver"])
    assert series.of_kind(matched, "counter").count() == 1
    assert series.of_kind(matched, "gauge", series.sampled_kind()).count() == 1


def test_equal_times_do_not_make_the_last_value_a_matter_of_luck(spark):
    rows = [
        sample(f"app.{i}.ExecutorMetrics.JVMHeapMemory", value=float(i), second=s)
        for i in range(1, 6)
        for s in (0, 60)
    ]
    panel = panels.memory_cpu_panel(samples(spark, *rows)).collect()
    assert [(r.host, r.last_value) for r in panel] == [("h", 5.0)]


def test_normalise_dataset(spark):
    names = ["apache_spark.driver", "databricks.spark_driver", "apache_spark.other", "x"]
    df = spark.createDataFrame([(n,) for n in names], "dataset string")
    assert [r[0] for r in metrics.normalise_dataset(df).collect()] == [
        "databricks.spark_driver",
        "databricks.spark_driver",
        "apache_spark.other",
        "x",
    ]

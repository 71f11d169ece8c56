from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import durations, mbeans, nesting
from tidewatch.schema.job_leaves import JOB_LEAVES
from tidewatch.schema.metric_leaves import METRIC_LEAVES, leaves_of, mapped_leaves


@pytest.mark.parametrize(
    "text, ms",
    [("5m", 300_000), ("1h30m", 5_400_000), ("250ms", 250), ("-5h", -18_000_000), ("1.5s", 1500)],
)
def test_parse_duration(text, ms):
    assert durations.parse_duration(text) == ms


@pytest.mark.parametrize("text", ["", "5", "5d", "m5", "5m x"])
def test_parse_duration_refuses(text):
    with pytest.raises(ValueError):
        durations.parse_duration(text)


def test_cutoff_is_a_whole_second():
    now = datetime(2001, 8, 2, 0, 0, 0, 999_999, tzinfo=timezone.utc)
    assert durations.cutoff_ms(now, "5m") == 996_710_100_000
    elsewhere = now.astimezone(timezone(timedelta(hours=5)))
    assert durations.cutoff_ms(elsewhere, "5m") == 996_710_100_000


def test_pretty_duration(spark):
    df = spark.createDataFrame([(3_723_999,), (0,), (None,), (90_000_000,)], "ms bigint")
    shown = [r[0] for r in df.select(durations.pretty_duration(F.col("ms"))).collect()]
    assert shown == ["1h 2m 3s", "0h 0m 0s", None, "25h 0m 0s"]


def test_leaf_counts():
    assert len(JOB_LEAVES) == 67
    counts = {"application": 5, "node": 9, "executor": 70, "driver": 72}
    assert {s: len(leaves_of(s)) for s in counts} == counts
    assert len(mapped_leaves()) == 147
    kinds = [leaf.kind for leaf in METRIC_LEAVES]
    assert kinds.count("counter") == 54 and kinds.count("gauge") == 94
    assert [leaf.attribute for leaf in mapped_leaves()].count("Value") == 98
    doubles = {leaf.field for leaf in METRIC_LEAVES if leaf.type == "double"}
    assert doubles == {
        "driver.spark.streaming.processing_rate.total",
        "driver.spark.streaming.input_rate.total",
    }


def test_nest_and_flatten(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    nested = df.select(*nesting.nest({"p.q.a": F.col("a"), "p.b": F.col("b"), "@c": F.col("a")}))
    assert nested.schema.simpleString() == "struct<p:struct<q:struct<a:int>,b:string>,@c:int>"
    assert nesting.flatten(nested).collect()[0].asDict() == {"p_q_a": 1, "p_b": "x", "c": 1}


def identities(spark, function, names):
    df = spark.createDataFrame([(n,) for n in names], "mbean string")
    rows = df.select(function(F.col("mbean")).alias("i")).collect()
    return [None if r.i is None else tuple(r.i) for r in rows]


OWNED = "metrics:name=app-1.{}.executor.bytesRead,type=counters"


def test_driver_and_executor_identity(spark):
    names = [
        OWNED.format("driver"),
        OWNED.format("7"),
        "metrics:name=worker.coresUsed,type=gauges",
        "metrics:name=application.app-1.4.cores,type=gauges",
        "metrics:name=master.workers,type=gauges",
        "nodots",
        "metrics:name=nodots",
        None,
    ]
    missing = "no application and id in metric name"
    assert identities(spark, mbeans.driver_identity, names) == [
        ("app-1", None, None),
        (None, None, "executor id in the driver stream"),
        None,
        None,
        (None, None, "executor id in the driver stream"),
        (None, None, missing),
        (None, None, missing),
        None,
    ]
    assert identities(spark, mbeans.executor_identity, names) == [
        (None, None, "driver id in the executor stream"),
        ("app-1", "7", None),
        None,
        None,
        ("master", "workers,type", None),
        (None, None, missing),
        (None, None, missing),
        None,
    ]


def test_application_identity(spark):
    names = [
        "metrics:name=application.app.42.cores,type=gauges",
        "x.y.name=application",
        "metrics:name=application.app",
        OWNED.format("1"),
        None,
    ]
    assert identities(spark, mbeans.application_identity, names) == [
        ("app.42", None, None),
        ("", None, None),
        (None, None, "no application in metric name"),
        None,
        None,
    ]

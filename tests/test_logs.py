"""Log reading, multi-line events in batch and as a stream, nodes and stored tables."""

from __future__ import annotations

import gzip
import random
import re
import subprocess
import sys
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewatch.operators import nodes
from tidewatch.operators.log_events import multiline
from tidewatch.schema.fixed_values import LOG_EVENT_START
from tidewatch.schema.source_types import LOG_LINE, NODE
from tidewatch.sinks import stream_tables
from tidewatch.sources import logs
from tidewatch.streaming.log_events import fold_lines, multiline_stream
from tidewatch.streaming.log_feed import LogEventFeed
from tidewatch.streaming.runs import run_available

START = "24/01/02 03:04:05 INFO"


def by_hand(lines, max_lines):
    """Events of one file's lines, line by line."""
    events = []
    for line in lines:
        if re.match(LOG_EVENT_START, line) or not events:
            events.append([])
        events[-1].append(line)
    return [("\n".join(e[:max_lines]), len(e), len(e) > max_lines) for e in events]


def random_files(seed, share=0.3):
    rng = random.Random(seed)
    return {
        f"f{f}": [
            f"{START} {i}" if rng.random() < share else rng.choice(["", "at x", f"line {i}"])
            for i in range(rng.randrange(1, 60))
        ]
        for f in range(6)
    }


def as_rows(files, block_lines):
    return [
        (file, i // block_lines * 1000, i, line)
        for file, lines in files.items()
        for i, line in enumerate(lines)
    ]


@pytest.mark.parametrize("seed, block_lines, max_lines", [(1, 1, 3), (2, 4, 2), (3, 1000, 5)])
def test_multiline(spark, seed, block_lines, max_lines):
    files = random_files(seed)
    rows = as_rows(files, block_lines)
    random.Random(seed).shuffle(rows)
    lines = spark.createDataFrame(rows, LOG_LINE)
    found = multiline(lines, max_lines=max_lines).orderBy("file", "event_seq").collect()
    for file, text in files.items():
        mine = [(r.message, r.n_lines, r.truncated) for r in found if r.file == file]
        assert mine == by_hand(text, max_lines)


def test_multiline_without_limit_loses_no_line(spark):
    files = {"long": [f"{START} a"] + ["x"] * 1500 + [f"{START} b"]}
    lines = spark.createDataFrame(as_rows(files, 100), LOG_LINE)
    first, second = multiline(lines, max_lines=1000).orderBy("event_seq").collect()
    assert (first.n_lines, first.truncated, first.message.count("\n")) == (1501, True, 999)
    assert (second.n_lines, second.truncated) == (1, False)
    assert multiline(lines, max_lines=5000).agg(F.sum("n_lines")).first()[0] == 1502


def test_fold_lines_marks_only_what_the_next_line_closes():
    frame = pd.DataFrame(
        [("f", 0, 0, "tail"), ("f", 0, 1, f"{START} a"), ("f", 0, 2, "x"), ("f", 0, 3, f"{START} b"),
         ("f", 0, 5, f"{START} c"), ("f", 1, 0, None)],
        columns=["file", "block", "pos", "value"],
    )
    folded = fold_lines(frame, LOG_EVENT_START, True, 10)
    shape = [tuple(r) for r in folded[["pos", "opens", "closed", "ends", "n_lines"]].to_numpy()]
    assert shape == [
        (0, False, True, False, 1),
        (1, True, True, False, 2),
        (3, True, False, False, 1),
        (5, True, False, False, 1),
        (0, False, False, True, 0),
    ]


@pytest.mark.parametrize("seed, max_lines", [(4, 1000), (5, 2)])
def test_stream_equals_batch(spark, tmp_path, seed, max_lines):
    files = random_files(seed, share=0.2)
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = as_rows(files, 7)
    ends = [(f, 10**6, 0, None) for f in files]
    for part in ([r for r in rows if r[2] < 9], [r for r in rows if r[2] >= 9], ends):
        spark.createDataFrame(part, LOG_LINE).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(LOG_LINE).parquet(landing)
        run_available(multiline_stream(stream, timeout=None, max_lines=max_lines), out, state)
    found = spark.read.parquet(out).orderBy("file", "block", "pos").collect()
    for file, text in files.items():
        mine = [(r.message, r.n_lines, r.truncated) for r in found if r.file == file]
        assert mine == by_hand(text, max_lines)


@pytest.mark.parametrize("seed, max_lines", [(4, None), (5, 2), (6, 1)])
def test_feed_equals_batch(spark, tmp_path, seed, max_lines):
    files = random_files(seed, share=0.2)
    files["most"] = [f"{START} {i}" if i % 11 == 5 else f"line {i}" for i in range(700)]
    rows = as_rows(files, 7)
    feed = LogEventFeed(spark, str(tmp_path), timeout=None, max_lines=max_lines)
    cuts = [0, 3, 9, 20, 10**9]
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if low <= r[2] < high]
        random.Random(batch).shuffle(part)
        lines = spark.createDataFrame(part, LOG_LINE).repartition(3)
        assert feed.apply(lines, batch) and not feed.apply(lines, batch)
        if batch == 1:
            feed.fold()
    feed.apply(spark.createDataFrame([(f, 10**6, 0, None) for f in files], LOG_LINE), len(cuts))
    found = feed.events().orderBy("file", "block", "pos").collect()
    for file, text in files.items():
        mine = [(r.message, r.n_lines, r.truncated) for r in found if r.file == file]
        assert mine == by_hand(text, max_lines or 10**9)


def test_a_file_goes_on_after_its_end_mark(spark, tmp_path):
    feed = LogEventFeed(spark, str(tmp_path), timeout=None)
    lines = [("f", 0, 0, f"{START} a"), ("f", 0, 1, None), ("f", 0, 2, "x"), ("f", 0, 3, f"{START} b")]
    feed.apply(spark.createDataFrame(lines, LOG_LINE), 0)
    assert [r.message for r in feed.events().orderBy("pos").collect()] == [f"{START} a", "x"]
    feed.apply(spark.createDataFrame([("f", 0, 4, None), ("g", 0, 0, None)], LOG_LINE), 1)
    assert [r.message for r in feed.events(1).collect()] == [f"{START} b"]


def test_a_silent_file_is_flushed_by_a_later_batch(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    feed = LogEventFeed(spark, str(tmp_path), timeout="10s")
    some = lambda file, pos, text: spark.createDataFrame([(file, 0, pos, text)], LOG_LINE)
    feed.apply(some("f", 0, f"{START} a"), 0, start)
    feed.apply(some("g", 0, f"{START} b"), 1, start + timedelta(seconds=5))
    assert feed.events().count() == 0
    feed.apply(some("g", 1, "x"), 2, start + timedelta(seconds=10))
    assert [(r.file, r.message) for r in feed.events().collect()] == [("f", f"{START} a")]
    feed.apply(some("f", 1, "late"), 3, start + timedelta(seconds=40))
    assert {(r.file, r.message) for r in feed.events().collect()} == {("f", f"{START} a"), ("g", f"{START} b\nx")}


def test_open_event_is_flushed_after_the_timeout(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = [("f", 0, 0, f"{START} a"), ("f", 0, 1, "x")]
    spark.createDataFrame(rows, LOG_LINE).write.parquet(landing)
    stream = spark.readStream.schema(LOG_LINE).parquet(landing)
    query = (
        multiline_stream(stream, timeout="1s")
        .writeStream.format("memory")
        .queryName("flushed")
        .trigger(processingTime="500 milliseconds")
        .start()
    )
    try:
        found = []
        for _ in range(60):
            found = spark.table("flushed").collect()
            if found:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert [(r.message, r.n_lines) for r in found] == [(f"{START} a\nx", 2)]


def test_executors_need_not_have_the_package(tmp_path):
    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps(fold_lines))
    load = "import pickle, pyspark.cloudpickle; print(pickle.load(open('f.bin', 'rb')).__name__)"
    done = subprocess.run(
        [sys.executable, "-c", load], cwd=tmp_path, env={}, capture_output=True, text=True
    )
    assert done.stdout.strip() == "fold_lines", done.stderr


def test_read_logs(spark, tmp_path):
    driver = tmp_path / "driver" / "logs"
    work = tmp_path / "spark" / "work" / "app-1" / "0"
    for folder in (driver, work):
        folder.mkdir(parents=True)
    for name in ("stdout-1", "stderr", "log4j.log", "x.out", "notes.txt"):
        (driver / name).write_text(f"{name}\nsecond\n")
    for name in ("stdout", "log4j-1.log", "other.log"):
        (work / name).write_text(f"{name}\n")
    with gzip.open(driver / "stdout-0.gz", "wt") as packed:
        packed.write("packed\n")
    read = logs.read_logs(spark, str(tmp_path), "driver")
    found = {r.value for r in read.filter("value <> 'second'").collect()}
    assert found == {"stdout-1", "stderr", "log4j.log", "x.out"}
    events = multiline(read).collect()
    assert all(r.message.endswith("\nsecond") for r in events) and len(events) == 4
    executor = logs.log_route(logs.read_logs(spark, str(tmp_path), "executor"))
    assert {(r.value, r.dataset) for r in executor.collect()} == {
        ("stdout", "spark.executor"),
        ("log4j-1.log", "spark.executor"),
    }
    assert {r.dataset for r in logs.log_route(read).collect()} == {"spark.driver"}


def test_node_facts(spark):
    inventory = [(h, f, "c", "ip", "t", "n", "TRUE") for h, f in
                 (("a", "TRUE"), ("b", "true"), ("c", None), ("d", "FALSE"))]
    known = spark.createDataFrame(inventory, NODE)
    rows = spark.createDataFrame([(h,) for h in "abcdx"], "host string")
    found = nodes.add_node_facts(rows, known).orderBy("host").collect()
    assert [r.node_role for r in found] == ["Driver", "Executor", "Executor", "Executor", "Executor"]
    assert [r.cluster_id for r in found] == ["c", "c", "c", "c", None]


def test_stream_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "set string, v int")
    rows = stream_tables.to_stream(df, "metrics", F.concat(F.lit("system."), "set"), "ns")
    for _ in range(2):
        stream_tables.write_stream_tables(rows, str(tmp_path / "t"), order=["v"])
    counts = stream_tables.stream_table_counts(
        stream_tables.read_stream_tables(spark, str(tmp_path / "t"))
    )
    assert {tuple(r) for r in counts.collect()} == {
        ("metrics-system.a-ns", 4),
        ("metrics-system.b-ns", 2),
    }


def test_facts_as_of_a_time_equal_a_scan_over_all_facts(spark):
    import random
    from datetime import datetime, timedelta

    pick = random.Random(7)
    start = datetime(2024, 1, 1)
    moment = lambda: start + timedelta(minutes=pick.randrange(6 * 24 * 60))
    seen = []
    for host in "abc":
        for _ in range(25):
            seen.append((host, "TRUE", pick.choice("xyz"), "ip", "t", "n", "TRUE", moment()))
        seen += seen[-2:]  # seen twice at once, and one that says something else
        seen.append((*seen[-1][:2], "zz", *seen[-1][3:]))
    seen.append(("d", "FALSE", "x", "ip", "t", "n", "TRUE", None))
    known = spark.createDataFrame(seen, f"{NODE}, seen_at timestamp")
    asked = [(pick.choice([*"abcde", None]), pick.choice([None, moment(), moment()]), i) for i in range(400)]
    asked += [(h, t, 1000 + i) for i, (h, *_, t) in enumerate(seen)]
    rows = spark.createDataFrame(asked, "node string, t timestamp, i int")
    for seconds in (3600, 86_400, 10**8):
        found = nodes.add_node_facts(rows, known, host="node", at="t", slice_seconds=seconds).collect()
        assert sorted(r.i for r in found) == sorted(i for *_, i in asked)
        for r in found:
            past = [s for s in seen if s[0] == r.node and r.t and (s[7] is None or s[7] <= r.t)]
            last = max(past, key=lambda s: (s[7] or datetime.min, s[2]), default=None)
            role = "Driver" if last and last[1] == "TRUE" else "Executor"
            assert (r.cluster_id, r.node_role) == (last and last[2], role), r


def test_lines_are_read_and_their_text_is_shuffled_once(spark, tmp_path):
    start = "24/01/02 03:04:05 x"
    spark.range(3000).selectExpr(
        "concat('f', id % 3) AS file", "id div 100 AS block", "id AS pos",
        f"if(id % 7 = 0 AND id % 900 < 300, '{start}', concat('line ', id)) AS value",
    ).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    events = multiline(lines)
    found = events.collect()
    plan = events._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2
    texts = {r.file: [] for r in found}
    for r in sorted(found, key=lambda r: (r.file, r.event_seq)):
        texts[r.file].append(r)
    for file, rows in texts.items():
        want = [r.value for r in lines.filter(lines.file == file).orderBy("pos").collect()]
        assert [line for r in rows for line in r.message.split("\n")] == want
        assert [r.event_seq for r in rows] == list(range(rows[0].event_seq, rows[0].event_seq + len(rows)))
        assert all(r.message.startswith(start) for r in rows if r.event_seq)
        assert all(start not in r.message[1:] for r in rows)

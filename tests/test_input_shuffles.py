"""What building the inputs shuffles, and that cut and whole numbering agree."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import inputs
from tidewatch.operators import sequences
from tidewatch.operators.sequences import with_row_number_sliced
from tidewatch.schema.source_types import LISTED_RUN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(text, node):
    """Lines of a plan tree under the first line that names the node."""
    lines = text.splitlines()
    at = next(n for n, line in enumerate(lines) if node in line)
    depth = lambda line: len(re.match(r"[ :|+*\-]*(\(\d+\) )?", line).group(0))
    rest = lines[at + 1 :]
    end = next((n for n, line in enumerate(rest) if depth(line) <= depth(lines[at])), len(rest))
    return "\n".join(rest[:end])


def numbered(df, **how):
    return with_row_number_sliced(df, ["k"], ["s", "r"], ["v"], "i", **how)


def test_rows_are_numbered_in_one_shuffle(spark):
    rows = [(k, s, s // 2, v) for k in (1, 2, 3) for s in (1, 2, 5) for v in (9, 7, 7)]
    rows += [(1, None, 0, 4), (2, 3, None, 4), (None, 1, 1, 1)] + [(4, 1, n % 7, n) for n in range(300)]
    df = spark.createDataFrame(rows, "k int, s int, r int, v int")
    whole, cut = numbered(df), numbered(df, crowd=0)
    assert plan(whole).count("Exchange") == 1
    assert "Union" in plan(cut)
    expected = df.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY s, r, v) AS i").filter(
        "k IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL"
    )
    rows_of = lambda x: sorted(map(tuple, x.select("k", "s", "r", "v", "i").collect()))
    assert rows_of(whole) == rows_of(expected) == rows_of(cut)


def test_page_chain_is_made_without_the_runs(spark):
    runs = [(1, 0), (2, 0), (1, 1), (250, 0), (None, 0)]
    listed = spark.createDataFrame(runs, "n bigint, chunk bigint").select(
        F.from_json(F.to_json(F.struct(F.col("n").alias("job_run_id"))), LISTED_RUN).alias("r"), "chunk"
    ).select("r.*", "chunk")
    pages = inputs.paged(listed, F.lit(2))
    assert "collect_list" not in below(plan(pages), "Window [lead")
    found = {(r[0], r[1], r[2]) for r in pages.select("page_token", "next_page_token", F.size("runs")).collect()}
    assert found == {("p0", "p0.1", 2), ("p0.1", "p1", 1), ("p2", "", 1), (None, "", 1)}


def test_tasks_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    rows = [(k, 1, k, k) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, s int, r int, v int")
    monkeypatch.setattr(sequences.dealt, "__defaults__", (5,))
    assert "hashpartitioning(k#" in plan(numbered(df)) and ", 8), REPARTITION_BY_NUM" in plan(numbered(df))
    assert plan(numbered(df)).count("Exchange") == 1
    assert sorted(r["i"] for r in numbered(df).collect()) == [1] * 40
    monkeypatch.setattr(inputs, "RUNS_DEALT", 5)
    listed = df.select(
        F.from_json(F.to_json(F.struct(F.col("k").alias("job_run_id"))), LISTED_RUN).alias("r"),
        F.lit(0).alias("chunk"),
    ).select("r.*", "chunk")
    pages = inputs.paged(listed, F.lit(0))
    assert ", 8), REPARTITION_BY_NUM" in plan(pages)
    assert [r[0] for r in pages.select(F.size("runs")).collect()] == [40]

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, frame
from tidewatch.llm import running_tree
from tidewatch.llm.context_tree import log_kt


def _model(rows, train):
    """The same mixture over dictionaries of (context, node)."""
    depth = running_tree.DEPTH
    counts, under = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    steps = lambda byte: [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def places(text):
        body = b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"
        whole = b"\n" * depth + body
        return [(whole[at - depth : at], whole[at]) for at in range(depth, len(whole))]

    for i, text, *_ in rows:
        for context, byte in places(text):
            for node, bit in steps(byte):
                for d in range(depth + 1):
                    own = context[depth - d :], node
                    counts[own][bit] += train(i)
                    if d < depth:
                        under[own].add(context[depth - d - 1 :])

    memo = {}

    def block(context, node):
        if (context, node) not in memo:
            own = float(log_kt(*(float(x) for x in counts[context, node])))
            both, weight = own, 1.0
            if len(context) < depth:
                below = sum(block(c, node)[0] for c in under[context, node])
                top = max(own, below)
                both = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
                weight = math.exp(own - math.log(2) - both)
            memo[context, node] = both, weight
        return memo[context, node]

    def score(text):
        total = 0.0
        for context, byte in places(text):
            for node, bit in steps(byte):
                one, rest = 0.0, 1.0
                for d in range(depth + 1):
                    zeros, ones = counts[context[depth - d :], node]
                    weight = block(context[depth - d :], node)[1]
                    one += rest * weight * (ones + 0.5) / (zeros + ones + 1)
                    rest *= 1 - weight
                total += math.log10(one if bit else 1 - one)
        return total

    return score


@pytest.mark.parametrize("frequent", [1, 300, running_tree.FREQUENT])
def test_running_score_equals_recursion(spark, frequent, monkeypatch):
    monkeypatch.setattr(running_tree, "FREQUENT", frequent)
    monkeypatch.setattr(running_tree, "CHUNK", 3_000)
    rows = [r for r in documents() if r[0] != 13]
    split = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 0
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    docs = frame(spark, rows, clash={"score": "x", "n": "y"})
    out = running_tree.score_texts(docs, train).collect()
    assert len(out) == len(rows)
    score = _model(rows, split)
    texts = {i: t for i, t, *_ in rows}
    for row in out:
        assert row["score"] == pytest.approx(score(texts[row["doc_id"]]), rel=1e-8)


def test_words_before_a_word_matter(spark):
    """A statistic across words: the same words in an order never seen score less."""
    rows = [(i, "aa bb " * 30, "en", "s", 1) for i in range(1, 5)]
    rows += [(100, "aa bb aa bb", "en", "s", 1), (101, "aa aa bb bb", "en", "s", 1)]
    out = running_tree.score_texts(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 100).collect()
    found = {r["doc_id"]: r for r in out}
    assert found[100]["base_score"] == pytest.approx(found[101]["base_score"])
    assert found[100]["score"] > found[101]["score"] + 2


def test_running_score_without_rows_or_training(spark):
    assert running_tree.score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    out = running_tree.score_texts(frame(spark), F.lit(False)).collect()
    assert {row["train_tokens"] for row in out} == {0}
    assert all(math.isfinite(row["score"]) and math.isfinite(row["base_score"]) for row in out)


def _shuffled(plan) -> int:
    """Rows written by all exchanges of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(_shuffled(children.apply(i)) for i in range(children.size()))


def test_no_row_is_shuffled_per_spelling_and_text(spark, monkeypatch):
    """Sums by text are sent, not occurrences: these took most of the disk."""
    monkeypatch.setattr(running_tree, "FREQUENT", 1)
    pick = random.Random(3)
    text = lambda: " ".join("".join(pick.choices("abcdefghij", k=6)) for _ in range(700))
    rows = [(i, text(), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    key = "spark.sql.autoBroadcastJoinThreshold"  # as if the tables were large
    spark.conf.set(key, "-1")
    try:
        out = running_tree.score_texts(docs, F.col("doc_id") % 3 != 0)
        assert len(out.collect()) == 30
    finally:
        spark.conf.unset(key)
    assert 0 < _shuffled(out._jdf.queryExecution().executedPlan()) < 30 * 700 // 4


@pytest.mark.parametrize("frequent", [1, 40])
def test_words_that_are_not_shipped_count_alike(spark, frequent, monkeypatch):
    rows = documents()
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    split = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 0
    monkeypatch.setattr(running_tree, "FREQUENT_WORDS", frequent)
    out = running_tree.score_texts(frame(spark, rows), train).collect()
    words = lambda text: (text or "").encode().lower().split()
    counts = collections.Counter(w for i, t, *_ in rows if split(i) for w in words(t))
    texts = sum(split(i) for i, *_ in rows)
    total, kinds = sum(counts.values()) + texts, len(counts) + 1
    chance = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    by_id = collections.defaultdict(list)
    for row in out:
        by_id[row["doc_id"]].append(row)
    assert len(out) == len(rows) and len(by_id[3]) == 2 and by_id[3][0][1:4] == by_id[3][1][1:4]
    for i, text, *_ in rows:
        row = by_id[i][0]
        assert (row["n_tokens"], row["train_tokens"]) == (len(words(text)) + 1, total)
        assert row["n_known"] == 1 + sum(counts[w] > 0 for w in words(text))
        base = chance(texts) + sum(chance(counts[w]) for w in words(text))
        assert row["base_score"] == pytest.approx(base, rel=1e-12)


def test_texts_in_another_order_are_told():
    columns = [np.zeros(2, np.int64)] * 5 + [np.zeros(2)] * 2 + [np.ones(2, np.int64)]
    row = (7, running_tree.TEXTS, 2, running_tree.pack(*columns))
    table = pa.table([pa.array([x]) for x in row], ["chunk", "kind", "size", "packed"])
    with pytest.raises(RuntimeError, match="another order"):
        running_tree._total(table)


def test_looked_up_blocks_equal_computed_ones():
    zeros = np.array([0.0, 1, 5, 4095, 4096, 2000, 1e6])
    ones = np.array([0.0, 7, 0, 1, 0, 2095, 3])
    assert running_tree.block_log_kt(zeros, ones) == pytest.approx(log_kt(zeros, ones), rel=1e-15)

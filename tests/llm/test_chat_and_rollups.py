from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tidewatch.llm import chat, token_rollups

ROWS = "conv_id bigint, turn bigint, role string, text string"
ODD = [
    "", "\\", "\\\\", "<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<s>", "a<", "|>b", ">", "<|", "[", "<<|end|>|>",
    "line\nline", "\U0001f600 <|user|>", "\\</s>", "[/INST]\\",
]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_is_undone_and_hides_controls(spark):
    table = spark.createDataFrame([(t,) for t in ODD], "text string")
    out = table.select("text", chat.escape(F.col("text")).alias("hidden")).withColumn("back", chat.unescape(F.col("hidden")))
    for row in out.collect():
        assert row["back"] == row["text"]
        assert not any(c in row["hidden"] for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|>/s[INST]\\ a\n", max_size=12), min_size=1, max_size=30))
def test_escape_of_any_text(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    assert table.filter(chat.unescape(chat.escape(F.col("text"))) != F.col("text")).count() == 0


def test_conversations_are_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(ODD)]
    rows += [(2, 1, "assistant", "b"), (2, 0, "user", None), (3, None, None, "x"), (3, 0, "a|b\\", "y")]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "no id")]
    rows += [(5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "v" * 100_000)]
    table = spark.createDataFrame(rows, ROWS).withColumn("segments", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table.repartition(3))).collect()}
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by_id.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        row = out[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == _digest("".join(f"{r}\n{t}\n" for *_, r, t in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), _digest(loss))
    assert [out[i]["in_order"] for i in (2, 3, 4, 5)] == [True, False, False, True]
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_formatting_plan_has_no_python(spark):
    rows = spark.range(3).select(
        F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")
    )
    plan = chat.digests(chat.format_conversations(rows))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def _change(spark, rows):
    kinds = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, operation string, seq int"
    return spark.createDataFrame(rows, kinds)


@pytest.fixture
def store(spark, tmp_path):
    return token_rollups.RollupStore(spark, str(tmp_path))


def _totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_rollups_follow_inserts_revisions_and_deletes(spark, store):
    assert _totals(store) == {}
    first = _change(spark, [
        (1, "a", "en", "t1", 10, "insert", 0), (2, "a", "en", "t1", 5, "insert", 0), (2, "a", "en", "t2", 7, "insert", 0),
        (3, None, None, "t1", 4, "insert", 0), (None, "a", "en", "t1", 99, "insert", 0), (4, "a", "en", "t1", None, "insert", 0),
        (5, "a", "en", "t1", 6, "other", 0),
    ])
    assert store.commit("b1", first)
    assert _totals(store) == {("a", "en", "t1"): (2, 15), ("a", "en", "t2"): (1, 7), (None, None, "t1"): (1, 4)}
    second = _change(spark, [
        (1, "b", "en", "t1", 12, "revise", 0), (2, "a", "en", "t1", None, "delete", 1), (2, "a", "en", "t1", 8, "revise", 0),
        (9, "a", "en", "t1", None, "delete", 0), (3, None, None, "t1", 5, "insert", 0),
    ])
    assert store.commit("b2", second)
    want = {("b", "en", "t1"): (1, 12), ("a", "en", "t2"): (1, 7), (None, None, "t1"): (1, 5)}
    assert _totals(store) == want
    assert not store.commit("b2", second)
    assert _totals(store) == want
    assert store.commit("b3", second.limit(0))
    assert _totals(store) == want


def test_a_failed_batch_is_written_again(spark, store):
    change = _change(spark, [(1, "a", "en", "t1", 10, "insert", 0)])
    store.commit("b1", change)
    # files of an attempt that ended before its mark
    half = change.select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.lit(1).alias("sign"), F.lit("b2").alias("batch"))
    half.write.parquet(f"{store.root}/ledger/b2")
    assert _totals(store) == {("a", "en", "t1"): (1, 10)}
    store.commit("b2", _change(spark, [(1, "a", "en", "t1", 3, "revise", 0)]))
    assert _totals(store) == {("a", "en", "t1"): (1, 3)}


def test_counts_of_odd_texts(spark):
    docs = frame(spark, clash={"n_tokens": "x"})
    versions = {"w": token_rollups.words, "p": token_rollups.word_pieces}
    out = token_rollups.counted(docs, versions, token_rollups.INSERT).collect()
    found = {(r["doc_id"], r["tokenizer"]): r["n_tokens"] for r in out}
    assert [found[i, "w"] for i in (6, 7, 8, 9, 12)] == [0, 0, 0, 3, 2]
    assert found[9, "p"] == 3

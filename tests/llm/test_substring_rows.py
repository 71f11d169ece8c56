from __future__ import annotations

import corpus_pipeline
import pytest

from tests.llm.helpers import SCHEMA, prose
from tidewatch.llm import substring_dedup


@pytest.mark.parametrize("batch", [60, substring_dedup.BATCH_WORDS])
@pytest.mark.parametrize("id", [None, 7])
def test_rows_of_one_id_keep_their_own_words(spark, monkeypatch, batch, id):
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", batch)
    passage, clean = prose(1, 30), prose(2, 40)
    repeated = f"{prose(3, 10)} {passage} {prose(4, 10)}"
    twins = [f"{prose(5, 25)} {prose(6 + k, 9)}" for k in range(2)]
    texts = [clean, repeated, *twins]
    rows = [(id, t, "en", "s", 1) for t in texts] + [(-5, f"start {passage}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r["text"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert len(out) == len(rows)
    assert out[clean]["n_removed"] == 0
    # null ids are first, so the passage is cut where the id is -5; else from the row with id 7
    assert out[repeated]["n_removed"] == (0 if id is None else 30)
    assert out[f"start {passage}"]["n_removed"] == (30 if id is None else 0)
    assert sorted(out[t]["n_removed"] for t in twins) == [0, 25]
    kept = {r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert clean in kept


def test_columns_named_like_inner_ones_stay(spark):
    text = prose(3, 30)
    rows = [(1, text, "a", "b", 7), (2, text, "c", "d", 8)]
    names = "doc_id bigint, text string, _doc_id string, _doc_rest string, n_words int"
    docs = spark.createDataFrame(rows, names)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert [(out[i]["_doc_id"], out[i]["_doc_rest"]) for i in (1, 2)] == [("a", "b"), ("c", "d")]
    assert [(out[i].n_words, out[i].n_removed) for i in (1, 2)] == [(30, 0), (30, 30)]
    assert out[2].text == text and out[2].kept_text == ""

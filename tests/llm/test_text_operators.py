from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, frame, prose
from tidewatch.llm import context_tree, language_id, pieces, toxicity
from tidewatch.llm.queries import piece_model_path


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def test_pieces_equal_the_library(spark, processor):
    docs = frame(spark, clash={"token_ids": "x", "decoded": "y"})
    path = piece_model_path()
    out = pieces.decode_documents(pieces.encode_documents(docs, path), path).collect()
    assert len(out) == len(documents())
    for row in out:
        ids = processor.encode(row["text"] or "")
        assert row["token_ids"] == ids
        assert row["decoded"] == processor.decode(ids)


def test_pieces_of_odd_strings_equal_the_library(processor):
    table = pieces.ChunkTable(processor)
    for text in (" ", "   ", "a", " a", "a ", "a  b", "\u2581", "\u2581a \u2581 b", "\n", "\n \n", "<s> </s>", "<0x0A>", "\x00a", "\u3000x"):
        assert table.ids(text) == processor.encode(text), repr(text)


def test_a_full_table_changes_nothing(processor, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_BYTES", 1000)
    table = pieces.ChunkTable(processor)
    for seed in range(5):
        text = prose(seed, 30)
        assert table.ids(text) == processor.encode(text)


def test_pieces_of_no_rows(spark):
    path = piece_model_path()
    docs = spark.createDataFrame([], SCHEMA)
    assert pieces.digests(pieces.decode_documents(pieces.encode_documents(docs, path), path)).count() == 0


def _unigrams(rows, train):
    counts, texts = collections.Counter(), 0
    for doc_id, text, *_ in rows:
        if train(doc_id):
            counts.update((text or "").encode().lower().split())
            texts += 1
    return counts, texts


@pytest.mark.parametrize("shipped", [0, context_tree.SHIPPED])
def test_context_tree_base_and_score(spark, shipped, monkeypatch):
    monkeypatch.setattr(context_tree, "FREQUENT", 50)
    rows = documents()
    docs = frame(spark, clash={"score": "x", "n_tokens": "y"})
    split = lambda i: zlib.crc32(str(i).encode()) % 3 != 0
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    out = context_tree.score_texts(docs, train, shipped=shipped).collect()
    assert len(out) == len(rows)
    counts, texts = _unigrams(rows, lambda i: i is not None and split(i))
    total, distinct = sum(counts.values()) + texts, len(counts) + 1
    chance = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    by_id = collections.defaultdict(list)
    for row in out:
        by_id[row["doc_id"]].append(row)
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        row = by_id[doc_id][0]
        assert row["train_tokens"] == total
        assert row["n_tokens"] == len(words) + 1
        assert row["n_known"] == 1 + sum(counts[w] > 0 for w in words)
        assert row["base_score"] == pytest.approx(chance(texts) + sum(chance(counts[w]) for w in words))
    assert len(by_id[3]) == 2
    model = _tree(rows, lambda i: i is not None and split(i))
    for doc_id in (0, 3, 7, 9, 15):
        row = by_id[doc_id][0]
        assert row["score"] == pytest.approx(model(row_text(rows, doc_id)), rel=1e-9)


def row_text(rows, doc_id):
    return next(text for i, text, *_ in rows if i == doc_id)


def _tree(rows, train):
    """The same mixture, by recursion over dictionaries."""
    counts, texts = _unigrams(rows, train)
    words = {w: counts[w] for _, t, *_ in rows for w in (t or "").encode().lower().split()}
    grams = collections.Counter()
    for w, c in words.items():
        whole = b" " + w + b" "
        for at in range(1, len(whole)):
            grams[whole[max(0, at - context_tree.DEPTH) : at], whole[at]] += c
    grams[b" ", 10] += texts
    leaves = collections.defaultdict(lambda: [0, 0])
    nodes = collections.defaultdict(set)
    for (context, byte), c in grams.items():
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            leaves[context, node][bit] += c
            for d in range(len(context)):
                nodes[context[len(context) - d :], node].add(context[len(context) - d - 1 :])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def block(context, node):
        key = context, node
        if key not in memo:
            if key in leaves:
                memo[key] = (*leaves[key], kt(*leaves[key]), 1.0)
            else:
                under = [block(c, node) for c in nodes[key]]
                a, b = sum(u[0] for u in under), sum(u[1] for u in under)
                own, below = kt(a, b), sum(u[2] for u in under)
                top = max(own, below)
                both = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
                memo[key] = (a, b, both, math.exp(own - math.log(2) - both))
        return memo[key]

    def chance(context, byte):
        total = 0.0
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            one, rest = 0.0, 1.0
            for d in range(len(context) + 1):
                a, b, _, weight = block(context[len(context) - d :], node)
                one += rest * weight * (b + 0.5) / (a + b + 1)
                rest *= 1 - weight
            total += math.log10(one if bit else 1 - one)
        return total

    def score(text):
        total = chance(b" ", 10)
        for w in (text or "").encode().lower().split():
            whole = b" " + w + b" "
            total += sum(
                chance(whole[max(0, at - context_tree.DEPTH) : at], whole[at]) for at in range(1, len(whole))
            )
        return total

    return score


def test_context_tree_without_rows_or_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert context_tree.score_texts(empty, F.lit(True)).count() == 0
    out = context_tree.score_texts(frame(spark), F.lit(False)).collect()
    assert {row["train_tokens"] for row in out} == {0}
    assert all(math.isfinite(row["score"]) and math.isfinite(row["base_score"]) for row in out)


def test_forward_sums_all_segmentations(processor):
    counts = {"en": collections.Counter({"the": 5, "thing": 2}), "de": collections.Counter({"der": 4, "ding": 1})}
    model = language_id.PieceModel.fit(counts, processor)
    words = ["the", "thing", "überall", "a", "xyzzyq", "the" * 30]
    got = language_id.word_scores(model, model.slots(), words)
    rows = {int(h): k for k, h in enumerate(model.hashes)}
    for word, scores in zip(words, got):
        marked = pieces.MARKER + word
        for column in range(2):
            alpha = [1.0]
            for j in range(1, len(marked) + 1):
                now = alpha[j - 1] * (1.0 if j == 1 else language_id.LETTER)
                for n in range(1, j + 1):
                    k = rows.get(language_id._hash(marked[j - n : j]))
                    if k is not None:
                        now += alpha[j - n] * model.probabilities[k, column]
                alpha.append(now)
            assert scores[column] == pytest.approx(math.log(alpha[-1]), rel=1e-9)


def learnt(processor):
    counts = {"en": collections.Counter({"the": 5, "thing": 2}), "de": collections.Counter({"der": 4, "ding": 1})}
    return language_id.PieceModel.fit(counts, processor)


def test_long_words_score_as_in_one_stretch(processor, monkeypatch):
    model = learnt(processor)
    pick = random.Random(3)
    words = ["".join(pick.choice("thedringа") for _ in range(n)) for n in (47, 48, 49, 130, 400)]
    monkeypatch.setattr(language_id, "SHORT", 10**9)
    whole = language_id.word_scores(model, model.slots(), words)
    monkeypatch.setattr(language_id, "SHORT", 1)
    monkeypatch.setattr(language_id, "STRETCH", 33)
    parts = language_id.word_scores(model, model.slots(), words)
    assert parts == pytest.approx(whole, rel=1e-9)
    monkeypatch.setattr(language_id, "SHORT", 10**9)
    monkeypatch.setattr(language_id, "BLOCK_LETTERS", 1)
    alone = language_id.word_scores(model, model.slots(), words)
    assert alone == pytest.approx(whole, rel=1e-9)


def test_a_very_long_word_among_many_takes_little_memory(processor):
    import tracemalloc

    model = learnt(processor)
    slots = model.slots()
    words = [prose(i, 1) + str(i) for i in range(20_000)]
    words[7] = "thing" * 40_000
    tracemalloc.start()
    scores = language_id.word_scores(model, slots, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert scores[7, 0] > scores[7, 1] and math.isfinite(scores[7, 0])


def test_marks_do_not_cut_words():
    assert language_id.words_of("हिन्दी भाषा, Ünï\u0308x 12") == ["हिन्दी", "भाषा", "ünï\u0308x"]


def test_texts_in_no_learnt_language_are_told(spark, processor):
    rows = [(1, "the thing of the", "en", "s", 1), (2, "日本語の文章です", None, "s", 1), (3, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit_language_model(docs, piece_model_path())
    found = language_id.predict_language(docs, model)
    assert [r.doc_id for r in found.filter(language_id.in_a_language()).collect()] == [1]
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit_language_model(language_id.training_rows(given), piece_model_path())
    found = language_id.predict_language(given, model).withColumn("in_one", language_id.in_a_language())
    lost = found.filter("NOT coalesce(in_one, false) AND lang_pred <> 'und'").count()
    assert lost == 0, found.agg(F.min("letter_score")).first()


def test_language_of_odd_texts(spark, processor):
    rows = [
        (1, "the thing of the", "en", "s", 1),
        (2, "der ding und der", "de", "s", 1),
        (3, None, "en", "s", 1),
        (4, "12 34", None, "s", 1),
        (5, "", "de", None, None),
        (6, "THE thing " * 5000, None, None, None),
        (None, "der", None, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    model = language_id.fit_language_model(docs, piece_model_path())
    out = {row["doc_id"]: row for row in language_id.predict_language(docs, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= row["score"] <= 1 for row in out.values())
    nothing = language_id.fit_language_model(docs.limit(0), piece_model_path())
    assert {r["lang_pred"] for r in language_id.predict_language(docs, nothing).collect()} == {"und"}
    assert language_id.predict_language(docs.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_language_model(language_id.training_rows(docs), piece_model_path())
    aside = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    out = language_id.predict_language(aside, model)
    assert out.filter("lang_pred <> lang").count() <= 0.01 * out.count()


def test_toxicity_learns_words_and_stems(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        word = ["grobian", "grobianisch", "scheusal"][i % 3]
        text = prose(i, 40) + (f" {word} {prose(i + 1, 20)}" if toxic else "")
        rows.append((i, text, "en" if i % 2 else "de", "s", 1))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity_model(docs, marks.filter("doc_id % 4 <> 1"))
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    right = [(out[i]["score"] >= 0.3) == bool(y) for i, y in labels if i % 4 == 1]
    assert sum(right) >= 0.97 * len(right)
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x" * 100_000, "en", "s", 0)], SCHEMA
    ).withColumn("score", F.lit("clash"))
    scored = toxicity.score_toxicity(odd, model).collect()
    assert all(0 <= row["score"] <= 1 for row in scored)
    assert scored[0]["score"] == scored[1]["score"]
    none = toxicity.fit_toxicity_model(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}


def test_toxicity_long_texts_by_blocks_equal_the_whole():
    import numpy as np

    random = np.random.default_rng(0)
    rows = [(random.integers(0, toxicity.TABLE**2, 30), k % 2) for k in range(40)]
    model = toxicity.train(rows)
    slots = random.integers(0, toxicity.TABLE**2, 450_000)
    whole = np.maximum(model.maxima(slots)[0], 0) @ model.weights + model.bias
    assert model.margin(slots) == pytest.approx(float(whole), rel=1e-4)


def test_digest_of_ids(spark, processor):
    path = piece_model_path()
    docs = spark.createDataFrame([(1, "hello world")], "doc_id bigint, text string")
    row = pieces.digests(pieces.decode_documents(pieces.encode_documents(docs, path), path)).first()
    ids = ",".join(map(str, processor.encode("hello world")))
    assert row["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()

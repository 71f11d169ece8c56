"""The classifier against a forward pass in plain Python, and on documents held out."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import prose
from tidewatch.llm import queries, toxicity


def plain_score(model, text: str) -> float:
    """Words hashed to two tables, each filter at every place of the padded text, its maximum."""
    vectors = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        whole = xxhash.xxh64_intdigest(word.encode()) % toxicity.TABLE
        stem = xxhash.xxh64_intdigest(word[: toxicity.STEM].encode(), 1) % toxicity.TABLE
        vectors.append([*model.first[whole].tolist(), *model.second[stem].tolist()])
    pad = max(toxicity.WIDTHS) - 1
    zero = [0.0] * (2 * toxicity.HALF)
    vectors = [zero] * pad + vectors + [zero] * pad
    total, unit = float(model.bias), 0
    for width, w, b in zip(toxicity.WIDTHS, model.filters, model.biases):
        w = w.tolist()
        for f in range(toxicity.FILTERS):
            best = max(
                sum(
                    vectors[at + k][d] * w[k][d][f]
                    for k in range(width)
                    for d in range(2 * toxicity.HALF)
                )
                for at in range(len(vectors) - width + 1)
            )
            total += max(best + float(b[f]), 0.0) * float(model.weights[unit])
            unit += 1
    return 1 / (1 + math.exp(-(model.scale * total + model.shift)))


@pytest.fixture(scope="module")
def model():
    slots = toxicity.WordSlots()
    rows = []
    for i in range(120):
        text = prose(i, 25) + (" scheusal" if i % 4 == 0 else "")
        rows.append((slots.of(text), int(i % 4 == 0)))
    return toxicity.train(rows)


def test_scores_equal_a_plain_forward_pass(model):
    slots = toxicity.WordSlots()
    pick = random.Random(1)
    texts = ["", "one", "Scheusal!", "a b", *(prose(500 + i, pick.randrange(1, 12)) for i in range(6))]
    texts += [t + " SCHEUSALE, 12 x" for t in texts[4:7]]
    for text in texts:
        assert model.score(slots.of(text)) == pytest.approx(plain_score(model, text), rel=1e-4, abs=1e-6)
    assert model.score(slots.of("the scheusal is")) > model.score(slots.of("the house is"))


def test_held_out_documents_of_the_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op2_toxicity(spark, folder).filter("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(F.col("toxic").isNotNull())
    rows = scored.join(labels, "doc_id").select("toxic", "predicted", "score").toPandas()
    hits = int(((rows.toxic == 1) & (rows.predicted == 1)).sum())
    assert len(rows) > 500 and hits >= 0.85 * rows.predicted.sum() and hits >= 0.8 * rows.toxic.sum()
    order = np.argsort(rows.score.to_numpy())
    ranks = np.empty(len(rows))
    ranks[order] = np.arange(len(rows))
    positive = rows.toxic.to_numpy() == 1
    area = (ranks[positive].mean() - (positive.sum() - 1) / 2) / (~positive).sum()
    assert area > 0.95

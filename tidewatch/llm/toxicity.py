"""Toxicity by a convolutional text classifier.

Words (runs of letters, lower case) become hashed embeddings: half of the dimensions by the
word, half by its first letters, so that inflected and compound forms share what is known of
their stem.  Filters of several
widths slide over all words of the text, the maximum of each filter goes through a logistic
layer.  Trained in numpy on a bounded sample of the labelled rows (``max_rows``, chosen by a
hash of the id); the output is calibrated on a part of the sample kept aside, where the
best threshold per language is found as well.  The score never sees the language.

Null and empty texts have the score of a text without words.  Without labelled rows of both
kinds every score is 0.  Extra columns stay; columns with an output's name are replaced.
The model has a fixed size whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import id_remainder

MAX_ROWS = 6000
TABLE = 1 << 17
HALF = 4
#: letters that make the stem
STEM = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
#: documents of the usual mix added to each slot before its odds are taken
SHRINK = 30
EPOCHS = 6
BATCH = 64
RATE = 0.1
WORD_LIMIT = 500_000
DEFAULT_THRESHOLD = 0.3
_LETTERS = regex.compile(r"\p{L}+")
_PAD = max(WIDTHS) - 1


class WordSlots(dict):
    """Both table places of a word, packed into one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORD_LIMIT:
            self.clear()
        whole = xxhash.xxh64_intdigest(word.encode()) % TABLE
        stem = xxhash.xxh64_intdigest(word[:STEM].encode(), 1) % TABLE
        value = self[word] = whole * TABLE + stem
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = _LETTERS.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class TextCnn:
    first: np.ndarray
    second: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = True

    def embed(self, slots: np.ndarray) -> np.ndarray:
        return np.hstack([self.first[slots // TABLE], self.second[slots % TABLE]])

    def maxima(self, slots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of each filter over the text, and where; texts are padded with
        zero embeddings, so each has a position."""
        best, where = [], []
        x = np.zeros((len(slots) + 2 * _PAD, 2 * HALF), np.float32)
        if len(slots):
            x[_PAD : _PAD + len(slots)] = self.embed(slots)
        for width, w, b in zip(WIDTHS, self.filters, self.biases):
            n = len(x) - width + 1
            z = x[:n] @ w[0]
            for k in range(1, width):
                z += x[k : k + n] @ w[k]
            at = z.argmax(axis=0)
            best.append(z[at, np.arange(FILTERS)] + b)
            where.append(at)
        return np.concatenate(best), where

    def margin(self, slots: np.ndarray) -> float:
        """Unlimited score of a text; very long ones go block by block, overlapping by the
        widest filter, as maxima of blocks are maxima of the whole."""
        step = 200_000
        top = self.maxima(slots[:step])[0]
        for start in range(step - _PAD, len(slots) - _PAD, step):
            top = np.maximum(top, self.maxima(slots[start : start + step + _PAD])[0])
        return float(np.maximum(top, 0) @ self.weights + self.bias)

    def score(self, slots: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(slots) + self.shift, -30, 30))))


def untrained() -> TextCnn:
    empty = np.zeros((TABLE, HALF), np.float32)
    return TextCnn(empty, empty, [], [], np.zeros(0), 0.0, trained=False)


def train(rows: list[tuple[np.ndarray, int]], seed: int = 7) -> TextCnn:
    """Adagrad on the logistic loss; ``rows``: words' slots and label."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
    labels = np.array([y for _, y in rows])
    first, second = _log_odds(rows, labels, draw)
    # one filter of each width starts on the log-odds dimensions, the rest at random
    filters = [draw(w, 2 * HALF, FILTERS) for w in WIDTHS]
    for w in filters:
        w[0, 0, 0] = w[0, HALF, 0] = 1.0
    weights = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    model = TextCnn(first, second, filters, biases, weights, -1.0)
    squares = {
        "first": np.full_like(first, 1e-2),
        "second": np.full_like(second, 1e-2),
        "weights": np.full_like(weights, 1e-2),
        "bias": 1e-2,
        **{f"w{i}": np.full_like(w, 1e-2) for i, w in enumerate(filters)},
        **{f"b{i}": np.full(FILTERS, 1e-2, np.float32) for i in range(len(WIDTHS))},
    }
    balance = (labels == 0).sum() / max(1, (labels == 1).sum())
    importance = np.where(labels == 1, min(balance, 20.0) ** 0.5, 1.0)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            _step(model, squares, rows, order[start : start + BATCH], importance)
    return model


def _log_odds(rows, labels, draw):
    """Embedding tables whose first dimension is how much likelier a toxic text holds the slot."""
    tables = []
    for part in (lambda s: s // TABLE, lambda s: s % TABLE):
        seen = [np.zeros(TABLE), np.zeros(TABLE)]
        for (slots, _), y in zip(rows, labels):
            seen[int(y)][np.unique(part(slots))] += 1
        n = [max(1, (labels == y).sum()) for y in (0, 1)]
        prior = (n[1] / (n[0] + n[1])) * SHRINK
        odds = np.log((seen[1] + prior) / (seen[1] + seen[0] + SHRINK)) - np.log(n[1] / (n[0] + n[1]))
        table = draw(TABLE, HALF)
        table[:, 0] = odds
        tables.append(table)
    return tables


def _step(model: TextCnn, squares: dict, rows, batch, importance) -> None:
    g_weights, g_bias = np.zeros_like(model.weights), 0.0
    g_filters = [np.zeros_like(w) for w in model.filters]
    g_biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    touched, moved = [], []
    for i in batch:
        slots, label = rows[i]
        top, where = model.maxima(slots)
        active = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.bias, -30, 30)))
        error = (p - label) * importance[i] / len(batch)
        g_weights += error * active
        g_bias += error
        back = error * model.weights * (top > 0)
        for k, (width, at) in enumerate(zip(WIDTHS, where)):
            part = back[k * FILTERS : (k + 1) * FILTERS]
            g_biases[k] += part
            for step in range(width):
                place = at + step - _PAD
                inside = (place >= 0) & (place < len(slots))
                if not inside.any():
                    continue
                there = slots[place[inside]]
                f = np.flatnonzero(inside)
                g_filters[k][step][:, f] += model.embed(there).T * part[f]
                touched.append(there)
                moved.append(model.filters[k][step][:, f].T * part[f][:, None])
    _adagrad(model.weights, g_weights, squares["weights"])
    squares["bias"] += g_bias**2
    model.bias -= RATE * g_bias / squares["bias"] ** 0.5
    for k in range(len(WIDTHS)):
        _adagrad(model.filters[k], g_filters[k], squares[f"w{k}"])
        _adagrad(model.biases[k], g_biases[k], squares[f"b{k}"])
    if touched:
        slots, moves = np.concatenate(touched), np.vstack(moved)
        for name, at, part in (
            ("first", slots // TABLE, moves[:, :HALF]),
            ("second", slots % TABLE, moves[:, HALF:]),
        ):
            place, back = np.unique(at, return_inverse=True)
            gradient = np.zeros((len(place), HALF), np.float32)
            np.add.at(gradient, back, part)
            squares[name][place] += gradient**2
            getattr(model, name)[place] -= RATE * gradient / np.sqrt(squares[name][place])


def _adagrad(values: np.ndarray, gradient: np.ndarray, squares: np.ndarray) -> None:
    squares += gradient**2
    values -= RATE * gradient / np.sqrt(squares)


def calibrate(model: TextCnn, rows: list[tuple[np.ndarray, int, str]]) -> None:
    """Platt scaling on rows kept aside, then the threshold of best F1 per language."""
    x = np.array([model.margin(slots) for slots, _, _ in rows])
    y = np.array([label for _, label, _ in rows], float)
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - step[0], 1e-3), b - step[1]
    model.scale, model.shift = float(a), float(b)
    scores = np.array([model.score(slots) for slots, _, _ in rows])
    for language in sorted({lang for _, _, lang in rows}):
        own = np.array([lang == language for _, _, lang in rows])
        if y[own].sum() >= 5:
            model.thresholds[language] = _best_threshold(scores[own], y[own])


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut of best F1; among equals the one nearest to a half."""

    def merit(cut: float) -> tuple[float, float]:
        hit = ((scores >= cut) & (labels == 1)).sum()
        return float(2 * hit / max(1, (scores >= cut).sum() + labels.sum())), -abs(cut - 0.5)

    return max((round(0.05 * k, 2) for k in range(1, 20)), key=merit)


def fit_toxicity_model(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS
) -> TextCnn:
    """Train on at most about ``max_rows`` labelled documents, a fifth of them to calibrate."""
    labelled = labels.select("doc_id", F.col("toxic").alias("label")).filter("label in (0, 1)")
    total = labelled.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = (
        labelled.filter(place < min(1.0, max_rows / max(1, total)))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))
    found = (
        docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
        .join(chosen, "doc_id")
        .select(part.alias("part"), "label", "lang", "doc_id", _slots_of()("text").alias("slots"))
        .orderBy("doc_id")
        .toArrow()
    )
    rows = [
        (r["part"], np.array(r["slots"], np.int64), r["label"], r["lang"])
        for batch in found.to_batches(256)
        for r in batch.to_pylist()
    ]
    learn = [(slots, label) for p, slots, label, _ in rows if p]
    if len({label for _, label in learn}) < 2:
        return untrained()
    model = train(learn)
    aside = [(slots, label, lang) for p, slots, label, lang in rows if not p]
    calibrate(model, aside or [(slots, label, "") for slots, label in learn])
    return model


def _slots_of():
    @F.arrow_udf("array<bigint>")
    def slots(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordSlots()
        for part in texts:
            yield pa.array([table.of(x.as_py()) for x in part], pa.list_(pa.int64()))

    return slots


def score_toxicity(docs: DataFrame, model: TextCnn, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``score`` for each whole text, and ``flagged`` by its language's threshold."""
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordSlots()
        for part in texts:
            yield pa.array([model.score(table.of(x.as_py())) for x in part], pa.float64())

    cut = F.lit(DEFAULT_THRESHOLD)
    if model.thresholds:
        cuts = F.create_map(*(F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair))
        cut = F.coalesce(F.try_element_at(cuts, F.coalesce(lang, F.lit(""))), cut)
    return docs.withColumn("score", score(F.col(text))).withColumn("flagged", F.col("score") >= cut)


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(id_remainder(F.col("doc_id"), 4) != 2)

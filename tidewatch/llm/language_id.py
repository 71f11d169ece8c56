"""Language identification by segmentation-marginalised unigrams.

For each language, probabilities of the pieces of a fixed public vocabulary are counted on a
bounded sample of labelled texts (at most ``rows_per_language`` documents in expectation,
chosen by a hash of the id).  A text scores, in each language, the sum over its words of the
logarithm of the word's probability, and that is the sum over all ways to cut the word into
pieces, taken by the forward algorithm.  Letters no piece covers have a fixed probability.

Words are runs of letters with their combining marks in lower case, with a marker in front.  The
score is the posterior probability of the predicted language with equal priors; the letter score
is the text's log likelihood in that language per letter, and tells texts in no learnt language.
Null texts and texts without a
letter are ``und`` with score 0 and no letter score; ties go to the first language in alphabetical order.  With
no labelled row to learn from, everything is ``und``.  Extra columns stay; columns that have
an output's name are replaced.  The model holds one row per piece and language and is
shipped with the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import give_back, id_remainder
from tidewatch.llm.pieces import MARKER, load_processor

UNKNOWN = "und"
ROWS_PER_LANGUAGE = 1500
#: probability of a letter outside the vocabulary
LETTER = 1e-6
#: added to each piece's count
SMOOTHING = 0.2
#: natural log likelihood per letter below which a text is in none of the languages: about half
#: its letters are in no piece that was learnt
FLOOR = -8.0
#: a task's table of words is emptied when it holds about so much
TABLE_BYTES = 48 << 20
#: of an entry, besides its letters and scores
ENTRY_BYTES = 200
SHORT = 48
BLOCK_LETTERS = 100_000
STRETCH = 8192
_WORD = r"\p{L}[\p{L}\p{M}]*"
_WORDS = regex.compile(_WORD)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


def _fold(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def _hash(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in _fold(np.array([ord(x) for x in text])):
        h = h * _BASE + c
    return int(h[0])


@dataclass
class PieceModel:
    """Pieces by hash, with a probability per language."""

    languages: list[str]
    hashes: np.ndarray
    probabilities: np.ndarray
    lengths: list[int]

    @classmethod
    def fit(cls, counts: dict[str, Counter], processor) -> PieceModel:
        """``counts``: words (without marker) by language."""
        pieces = {}
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            letters = piece.removeprefix(MARKER)
            if _WORDS.fullmatch(letters) and letters == letters.lower():
                pieces[i] = piece
        place = {i: k for k, i in enumerate(pieces)}
        languages = sorted(counts)
        table = np.full((len(pieces), len(languages)), SMOOTHING)
        for column, language in enumerate(languages):
            words = list(counts[language])
            for word, ids in zip(words, processor.encode(words, num_threads=1)):
                for i in ids:
                    if i in place:
                        table[place[i], column] += counts[language][word]
        table /= table.sum(axis=0)
        hashes = np.array([_hash(piece) for piece in pieces.values()], np.uint64)
        return cls(languages, hashes, table, sorted({len(p) for p in pieces.values()}))

    def slots(self) -> list[np.ndarray]:
        """Places of the pieces by the top bits of their hash; a piece that finds its place
        taken goes to the next layer."""
        layers, rest = [], np.arange(len(self.hashes))
        while len(rest):
            layer = np.full(1 << _SLOT_BITS, -1, np.int32)
            at = (self.hashes[rest] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            layer[at[::-1]] = rest[::-1]
            layers.append(layer)
            rest = rest[layer[at] != rest]
        return layers


def find(model: PieceModel, slots: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Row of each hash in the model, or -1."""
    found = np.full(len(hashes), -1, np.int32)
    at = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    for layer in slots:
        row = layer[at]
        hit = row >= 0
        hit[hit] = model.hashes[row[hit]] == hashes[hit]
        found[hit] = row[hit]
    return found


def word_scores(model: PieceModel, slots: list[np.ndarray], words: list[str]) -> np.ndarray:
    """Natural log probability of each word in each language, over all segmentations.

    Words of up to ``SHORT`` letters go side by side in blocks of bounded letters, longer ones
    one at a time, a stretch of letters after the other.
    """
    scores = np.zeros((len(words), len(model.languages)))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    short = sum(len(word) <= SHORT for word in words)
    first = 0
    while first < short:
        # sorted by length: the last word of a block is its longest
        last = min(short, first + BLOCK_LETTERS // (len(words[order[first]]) + 1))
        last = min(last, first + BLOCK_LETTERS // (len(words[order[last - 1]]) + 1))
        block = order[first : max(last, first + 1)]
        scores[block] = _side_by_side(model, slots, [MARKER + words[i] for i in block])
        first += len(block)
    for i in order[short:]:
        scores[i] = _along(model, slots, MARKER + words[i])
    return scores


def _letter_codes(text: str) -> np.ndarray:
    return _fold(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _pieces_ending(
    model: PieceModel, slots: list[np.ndarray], codes: np.ndarray
) -> np.ndarray:
    """Row of the piece of each of the model's lengths that ends at each letter, or -1."""
    found = np.full((len(model.lengths), len(codes)), -1, np.int32)
    window = np.zeros(len(codes), np.uint64)
    for n in range(1, min(max(model.lengths, default=0), len(codes)) + 1):
        # the hash of the n letters up to each place, from that of the n - 1 before the last
        window = window[:-1] * _BASE + codes[n - 1 :] if n > 1 else codes.copy()
        if n in model.lengths:
            found[model.lengths.index(n), n - 1 :] = find(model, slots, window)
    return found


def _side_by_side(model: PieceModel, slots: list[np.ndarray], words: list[str]) -> np.ndarray:
    """``words`` in order of length; finished ones leave the block."""
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ends_at = _pieces_ending(model, slots, _letter_codes("".join(words)))
    out = np.zeros((len(words), len(model.languages)))
    alpha = {0: np.ones_like(out)}
    scale = np.zeros(len(words))
    reach = max(model.lengths, default=1)
    gone = 0
    for j in range(1, int(lengths.max()) + 1):
        # the marker is no letter: a word may start with it on its own at no cost
        now = alpha[j - 1] * (1.0 if j == 1 else LETTER)
        at = starts[gone:] + (j - 1)
        for k, n in enumerate(model.lengths):
            if n > j:
                break
            row = ends_at[k, at]
            hit = np.flatnonzero(row >= 0)
            if len(hit):
                now[hit] += alpha[j - n][hit] * model.probabilities[row[hit]]
        alpha[j] = now
        alpha.pop(j - reach, None)
        if j % 16 == 0:
            top = now.max(axis=1)
            top[top == 0] = 1.0
            for part in alpha.values():
                part /= top[:, None]
            scale += np.log(top)
        ended = int(np.searchsorted(lengths[gone:], j, "right"))
        if ended:
            out[gone : gone + ended] = np.log(np.maximum(now[:ended], 1e-300)) + scale[:ended, None]
            alpha = {place: part[ended:] for place, part in alpha.items()}
            scale, gone = scale[ended:], gone + ended
    return out


def _along(model: PieceModel, slots: list[np.ndarray], word: str) -> np.ndarray:
    """One word of any length, in stretches that overlap by the longest piece."""
    reach = max(model.lengths, default=1)
    lengths = np.array(model.lengths, np.int64)
    table = np.concatenate([model.probabilities, np.zeros((1, len(model.languages)))])
    # alpha of the last ``reach`` places; the one before the word is 1, none is before that
    recent = np.zeros((reach, len(model.languages)))
    recent[-1] = 1.0
    scale = 0.0
    for start in range(0, len(word), STRETCH):
        before = min(start, reach)
        codes = _letter_codes(word[start - before : start + STRETCH])
        ends_at = _pieces_ending(model, slots, codes)[:, before:]
        alpha = np.concatenate([recent, np.zeros((ends_at.shape[1], len(model.languages)))])
        for j in range(ends_at.shape[1]):
            at = reach + j
            now = alpha[at - 1] * (1.0 if start + j == 0 else LETTER)
            now += (alpha[at - lengths] * table[ends_at[:, j]]).sum(axis=0)
            alpha[at] = now
            if j % 16 == 15:
                top = now.max()
                alpha[at - reach + 1 : at + 1] /= top
                scale += np.log(top)
        recent = alpha[-reach:]
    return np.log(np.maximum(recent[-1], 1e-300)) + scale


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class WordTable:
    """Scores of distinct words; emptied at ``TABLE_BYTES``."""

    def __init__(self, model: PieceModel):
        self.model, self.slots = model, model.slots()
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.taken = 0

    def add(self, words: set[str]) -> None:
        new = list(words.difference(self.place))
        if self.taken > TABLE_BYTES:
            self._empty()
            new = list(words)
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.scores = np.concatenate([self.scores, word_scores(self.model, self.slots, new)])
            self.taken += sum(map(len, new)) + (ENTRY_BYTES + 8 * self.scores.shape[1]) * len(new)

    def total(self, words: list[str]) -> np.ndarray:
        counts = Counter(words)
        places = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
        return np.fromiter(counts.values(), np.float64, len(counts)) @ self.scores[places]


def _predictions(table: WordTable, texts: pa.Array) -> Iterator[tuple[str, float, float | None]]:
    languages = table.model.languages
    for first in range(0, len(texts), 256):
        rows = [words_of(x.as_py()) for x in texts[first : first + 256]]
        table.add({word for row in rows for word in row} if languages else set())
        for row in rows:
            if not row or not languages:
                yield UNKNOWN, 0.0, None
                continue
            total = table.total(row)
            best = int(total.argmax())
            posterior = float(1.0 / np.exp(total - total[best]).sum())
            yield languages[best], posterior, float(total[best]) / sum(map(len, row))


def predictor(model: PieceModel):
    """A column function: text to ``struct<lang, score, letter_score>``."""

    @F.arrow_udf("struct<lang:string,score:double,letter_score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordTable(model)
        for part in texts:
            lang, score, letter = zip(*_predictions(table, part)) if len(part) else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letter, pa.float64())],
                ["lang", "score", "letter_score"],
            )
        del table
        give_back()

    return predict


def fit_language_model(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> PieceModel:
    """Learn from a bounded sample of the rows that have a language and a text."""
    labelled = docs.select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return PieceModel([], np.zeros(0, np.uint64), np.zeros((0, 0)), [])
    share = F.create_map(
        *(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, rows_per_language / n)))
    )
    # the hash of the id, as a fraction of its range, against the language's share
    place = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / 1_000_003
    sample = labelled.filter(place < share[F.col("lang")])
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("word")
    counted = (
        sample.select("lang", word)
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .toPandas()
    )
    counts = {
        name: Counter(dict(zip(part["word"], part["n"]))) for name, part in counted.groupby("lang")
    }
    return PieceModel.fit(counts, load_processor(model_path))


def predict_language(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``letter_score`` for each whole text."""
    found = "_language"
    return (
        docs.withColumn(found, predictor(model)(F.col(text)))
        .withColumn("lang_pred", F.col(found)["lang"])
        .withColumn("score", F.col(found)["score"])
        .withColumn("letter_score", F.col(found)["letter_score"])
        .drop(found)
    )


def in_a_language() -> Column:
    """Whether a row has letters that some learnt language is likely to hold."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("letter_score") >= FLOOR)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(id_remainder(F.col("doc_id"), 4) != 2)

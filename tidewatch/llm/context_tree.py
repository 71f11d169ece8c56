"""Context-tree weighting over the bytes within words; across words, see ``running_tree``.

Texts are words (letters A-Z lower-cased, runs without the six ASCII blanks), each spelled as
its UTF-8 bytes and a blank, and an end sign.  A byte is predicted from up to ``DEPTH`` bytes
before it, back to the blank that precedes its word: contexts do not reach across words, so
a word has one probability and is scored once, whatever the number of texts that hold it.
Each byte is eight binary decisions; every context of every decision has a Krichevsky-Trofimov
estimate, and the estimates of all depths are mixed with the weights of the tree.

Nodes of the tree are rows: counts and block probabilities are summed from the deepest
contexts up by ``groupBy``, mixtures are handed down by joins on the parent context.  Spellings
seen only in texts held out are nodes with no counts, so they need no other rule.

The unigram base and the score of a text are sums over its words.  Words that make up at least
1 / ``FREQUENT`` of all tokens, at most that many, are shipped with the tasks; all others are
joined by their 64-bit hash.  The spelling table is shipped only up to ``SHIPPED`` rows and
joined beyond.

Null texts are empty: they have the end sign alone.  A null id counts as empty text where
rows are split.  Repeated rows each count and get equal results.  With no training rows
every estimate is the one without counts.  Other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import MASK64, land, row_tie

DEPTH = 5
FREQUENT = 1 << 16
SHIPPED = 2_000_000
DISTINCT = 150_000
BLANK, END = 0x20, 0x0A
#: added to each count of the base
ADDED = 0.1
_HALF = math.log(0.5)
_CONTEXT_BITS = 8 * DEPTH


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """``docs``: train and text. ``word, c, n``: its tokens in training and in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())

        def emit():
            words = list(both[0].keys() | both[1].keys())
            for start in range(0, len(words), 50_000):
                part = words[start : start + 50_000]
                c = [both[1][w] for w in part]
                n = [x + both[0][w] for w, x in zip(part, c)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())],
                    names=["word", "c", "n"],
                )
            both[0].clear()
            both[1].clear()

        for batch in batches:
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                both[train].update(words_of(text.as_py()))
                if len(both[0]) + len(both[1]) > DISTINCT:
                    yield from emit()
        yield from emit()

    return (
        docs.mapInArrow(count, "word binary, c bigint, n bigint")
        .groupBy("word")
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    )


def spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with the byte that follows, packed, for all bytes of all words; and the word
    each belongs to.  A packed spelling is (length of context, its bytes, next byte)."""
    text = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    offset = np.arange(len(text)) - starts[owner]
    at = np.flatnonzero(offset > 0)
    context, length = np.zeros(len(at), np.int64), np.minimum(offset[at], DEPTH)
    for back in range(1, DEPTH + 1):
        inside = length >= back
        context[inside] |= text[at[inside] - back] << (8 * (back - 1))
    return ((length << _CONTEXT_BITS | context) << 8) | text[at], owner[at]


END_SPELLING = ((1 << _CONTEXT_BITS | BLANK) << 8) | END


def count_spellings(words: DataFrame) -> DataFrame:
    """``spelling, c`` over the distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed, owner = spellings(batch.column(0).to_pylist())
            kinds, back = np.unique(packed, return_inverse=True)
            c = np.zeros(len(kinds), np.int64)
            np.add.at(c, back, batch.column(1).to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(c)], names=["spelling", "c"])

    return (
        words.select("word", "c")
        .mapInArrow(count, "spelling bigint, c bigint")
        .groupBy("spelling")
        .agg(F.sum("c").alias("c"))
    )


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, from eight above the argument."""
    shifted = x + 8.0
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    total = (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series
    for k in range(8):
        total -= np.log(x + k)
    return total


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return (
        log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi)
        - log_gamma(zeros + ones + 1.0)
    )


def _log_kt(zeros: pa.Array, ones: pa.Array) -> pa.Array:
    return pa.array(log_kt(zeros.to_numpy().astype(float), ones.to_numpy().astype(float)))


def _bits() -> Column:
    """The eight decisions of a byte: node in the tree of its bits, and the bit."""
    steps = F.sequence(F.lit(0), F.lit(7))
    byte = F.col("spelling").bitwiseAND(255)

    def decision(k: Column) -> Column:
        node = F.call_function("shiftleft", F.lit(1).cast("bigint"), k).bitwiseOR(
            F.call_function("shiftright", byte, 8 - k)
        )
        bit = F.call_function("shiftright", byte, 7 - k).bitwiseAND(1)
        return F.struct(node.alias("node"), bit.alias("bit"))

    return F.inline(F.transform(steps, decision))


def _depth(context: str) -> Column:
    return F.shiftright(context, _CONTEXT_BITS)


def _parent(depth: int) -> Column:
    """The context without its farthest byte; ``depth`` is the parent's."""
    return (F.col("context").bitwiseAND((1 << 8 * depth) - 1)).bitwiseOR(
        F.lit(depth << _CONTEXT_BITS)
    )


def score_spellings(spelled: DataFrame) -> DataFrame:
    """``spelling, log10``: the mixture's probability of each next byte."""
    bits = spelled.select(
        F.shiftright("spelling", 8).alias("context"), "spelling", "c", _bits()
    )
    leaves = land(
        bits.groupBy("context", "node").agg(
            F.sum(F.when(F.col("bit") == 0, F.col("c")).otherwise(0)).alias("zeros"),
            F.sum(F.when(F.col("bit") == 1, F.col("c")).otherwise(0)).alias("ones"),
        ),
        "tree-leaves",
    )
    levels: dict[int, DataFrame] = {}
    own = F.arrow_udf(_log_kt, "double")("zeros", "ones").alias("own")
    for depth in range(DEPTH, -1, -1):
        level = leaves.filter(_depth("context") == depth).select(
            "context", "node", "zeros", "ones", F.lit(True).alias("leaf"), F.lit(0.0).alias("below")
        )
        if depth < DEPTH:
            level = level.unionByName(
                levels[depth + 1]
                .groupBy(_parent(depth).alias("context"), "node")
                .agg(
                    F.sum("zeros").alias("zeros"),
                    F.sum("ones").alias("ones"),
                    F.lit(False).alias("leaf"),
                    F.sum("block").alias("below"),
                )
            )
        level = level.select("*", own)
        low, high = F.least("own", "below"), F.greatest("own", "below")
        mixed = high + F.log1p(F.exp(low - high)) + _HALF
        block = F.when(F.col("leaf"), F.col("own")).otherwise(mixed)
        level = level.withColumn("block", block).withColumn(
            "weight",
            F.when(F.col("leaf"), 1.0).otherwise(F.exp(F.col("own") + _HALF - F.col("block"))),
        )
        levels[depth] = land(level.drop("own", "below"), f"tree-{depth}")
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    down = levels[0].select(
        "context", "node", (F.col("weight") * one).alias("sum"), (1 - F.col("weight")).alias("rest")
    )
    ends = None
    for depth in range(1, DEPTH + 1):
        above = down.select(
            F.col("context").alias("parent"), "node", F.col("sum").alias("sum_above"), F.col("rest").alias("rest_above")
        )
        # contexts that end here are few above the full depth: the chain is short for each
        mixed = [
            levels[depth]
            .filter(kind)
            .withColumn("parent", _parent(depth - 1))
            .join(above, ["parent", "node"])
            .select(
                "context",
                "node",
                (F.col("sum_above") + F.col("rest_above") * F.col("weight") * one).alias("sum"),
                (F.col("rest_above") * (1 - F.col("weight"))).alias("rest"),
            )
            for kind in ("leaf", "not leaf")
        ]
        ends = mixed[0] if ends is None else ends.unionByName(mixed[0])
        down = mixed[1]
    chance = F.when(F.col("bit") == 1, F.col("sum")).otherwise(1 - F.col("sum"))
    return (
        bits.join(ends.select("context", "node", "sum"), ["context", "node"])
        .groupBy("spelling")
        .agg(F.sum(F.log10(chance)).alias("log10"))
    )


def score_words(words: DataFrame, table: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """Add ``score`` to ``words``: the sum over its spellings."""
    if table.count() <= shipped:
        local = table.toArrow()
        keys, values = local["spelling"].to_numpy(), local["log10"].to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        del local, order

        @F.arrow_udf("double")
        def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                if not len(part):
                    yield pa.array([], pa.float64())
                    continue
                packed, owner = spellings(part.to_pylist())
                each = values[np.searchsorted(keys, packed)]
                yield pa.array(np.bincount(owner, each, minlength=len(part)))

        return words.withColumn("score", score("word"))

    @F.arrow_udf("array<bigint>")
    def spelled(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = [spellings([w])[0] for w in part.to_pylist()]
            yield pa.array(rows, pa.list_(pa.int64()))

    sums = (
        words.select("word", F.explode(spelled("word")).alias("spelling"))
        .join(table, "spelling")
        .groupBy("word")
        .agg(F.sum("log10").alias("score"))
    )
    return words.join(sums, "word")


_PARTS = (
    "key bigint, doc bigint, row bigint, own int, times bigint, n_tokens bigint, n_bytes bigint, "
    "n_known bigint, base double, score double"
)


def _parts(frequent: dict, floor: float, end: tuple[float, float, int]):
    """Rows per text: one of its own with sums over frequent words, one per other word."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        hashes = frequent["hash"]

        def look_up(word: bytes) -> tuple:
            h = xxhash.xxh64_intdigest(word, 42)
            signed = h - (1 << 64) if h >> 63 else h
            at = int(np.searchsorted(hashes, signed))
            if at < len(hashes) and hashes[at] == signed:
                found = (None, frequent["base"][at], frequent["score"][at], int(frequent["c"][at] > 0))
            else:
                found = (signed, 0.0, 0.0, 0)
            if len(known) >= DISTINCT:
                known.clear()
            known[word] = found
            return found

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                columns: list[list] = [[] for _ in range(10)]
                part = batch.slice(start, 500)
                for doc, row, text in zip(*(part.column(i) for i in range(3))):
                    doc, row, words = doc.as_py(), row.as_py(), words_of(text.as_py())
                    base, score, n_known = end
                    size = 1
                    for word, n in Counter(words).items():
                        key, b, s, k = known.get(word) or look_up(word)
                        size += n * (len(word) + 1)
                        if key is None:
                            base += n * b
                            score += n * s
                            n_known += n * k
                        else:
                            values = (key, doc, row, 0, n, None, None, None, None, None)
                            for column, value in zip(columns, values):
                                column.append(value)
                    own = ((doc or 0) * 0x9E3779B97F4A7C15 + row) & MASK64  # spreads these rows
                    own = own - (1 << 64) if own >> 63 else own
                    values = (own, doc, row, 1, None, len(words) + 1, size, n_known, base, score)
                    for column, value in zip(columns, values):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.float64()] * 2]
                names = [x.split()[0] for x in _PARTS.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
                )

    return parts


def text_parts(
    rows: DataFrame, scored: DataFrame, n: int, floor: float, end: tuple[float, float, int]
) -> DataFrame:
    """Rows that sum up to each text's base and score; ``n`` is the number of all tokens."""
    often = scored.filter(F.col("n") * FREQUENT >= n)
    local = often.select("key", "c", "word_base", "word_score").toArrow()
    order = np.argsort(local["key"].to_numpy())
    columns = {"hash": "key", "c": "c", "base": "word_base", "score": "word_score"}
    frequent = {name: local[column].to_numpy()[order] for name, column in columns.items()}
    del local
    parts = rows.select("doc", "row", "text").mapInArrow(_parts(frequent, floor, end), _PARTS)
    return parts.join(
        scored.filter(F.col("n") * FREQUENT < n).select("key", "c", "word_base", "word_score"),
        "key",
        "left",
    )


def by_text(joined: DataFrame, total: int, id: str) -> DataFrame:
    """A row per text from its parts; ``total`` is the number of training tokens."""
    times = F.coalesce("times", F.lit(0))
    per_text = joined.groupBy("doc", "row").agg(
        F.sum("own").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, times), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", times * F.col("word_base"))).alias("base"),
        F.sum(F.coalesce("score", times * F.col("word_score"))).alias("score"),
    )
    return (
        per_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            F.col("doc").alias(id),
            (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
            (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") / F.col("copies")).alias("base_score"),
            (F.col("score") / F.col("copies")).alias("score"),
            (-F.col("score") / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
        )
    )


def score_texts(
    docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", shipped: int = SHIPPED
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``train``: whether a row may be learnt from.
    """
    rows = docs.select(
        F.col(id).cast("long").alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text")
    )
    rows = rows.withColumn("row", row_tie(rows, "doc", "text"))
    words = land(count_words(rows.select("train", "text")), "words")
    texts = rows.filter("train").count()
    sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("c") > 0, 1)).alias("v"),
    ).first()
    total, distinct = sums["c"] + texts, sums["v"] + (texts > 0)
    spark = docs.sparkSession
    ending = spark.createDataFrame([(END_SPELLING, texts)], "spelling bigint, c bigint")
    spelled = land(count_spellings(words).unionByName(ending), "spellings")
    table = land(score_spellings(spelled), "spelling-scores")
    floor = ADDED * (distinct + 1) + total
    base = F.log10((F.col("c") + ADDED) / floor)
    scored = land(
        score_words(words, table, shipped).select(
            F.xxhash64("word").alias("key"), "c", "n", base.alias("word_base"), F.col("score").alias("word_score")
        ),
        "scored-words",
    )
    end_score = table.filter(F.col("spelling") == END_SPELLING).first()["log10"]
    end = (math.log10((texts + ADDED) / floor), end_score, int(texts > 0))
    return by_text(text_parts(rows, scored, sums["n"], floor, end), total, id)

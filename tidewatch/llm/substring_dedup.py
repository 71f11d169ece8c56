"""Removal of passages that occur earlier, by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  Positions whose remainder modulo
13 is 0, 1, 3 or 9 are a difference cover: for any two positions there is a shift below 13
that takes both onto it.  So two equal windows share an anchor, a run of 8 words that starts
at a cover position in both, at the same distance from the start.  Only anchors are hashed
and counted over the corpus; windows are then extended around anchors that occur at least
twice, and a window whose hash also occurs earlier marks its words.  Anchors only choose
windows; the decision is by the whole window, on the input.

Before each shuffle the rows of a batch are folded: of what occurs several times in a batch
only one row goes to the key, and the others, whose answer is known, travel under keys of
their own.  So a key has at most one row per batch, however common the passage.

Words are runs without the six ASCII blanks, unchanged.  Null texts have no words.  Documents
are ordered by id, null ids first, those of one id by a hash of id and text.  Id and hash are also
what brings marks and starts back to a row, so only equal rows share them: their equal starts
are not earlier than each other, and a start found to be a repeat is one in all of them.  Of ids
that a bitmap of fixed size knows to occur once the hash is left out, as it would not compress.
Extra columns stay; columns that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import (
    WordHashes,
    give_back,
    key_bitmap,
    land,
    maybe_among,
    mix,
    window_hashes,
)

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: words handled together; a longer document is handled on its own
BATCH_WORDS = 2_000_000
_NULL_ID = -(1 << 63)
#: words of 64 bits in the bitmap of ids that occur several times
SLOTS = 1 << 18
#: columns that carry id, hash, text, marked anchors and a row's other columns, whatever their names
ID, TIE, TEXT, MARKS, REST = "_doc_id", "_doc_tie", "_doc_text", "_doc_marks", "_doc_rest"
_ROWS = "key bigint, id bigint, tie bigint, place bigint"


def _documents(batches: Iterator[pa.RecordBatch], with_marks: bool = False):
    """Groups of documents with about ``BATCH_WORDS`` words: ids, ties, word hashes, marks."""
    table = WordHashes()
    group, total = [], 0
    for batch in batches:
        ids, ties, texts = batch.column(ID), batch.column(TIE), batch.column(TEXT)
        marks = batch.column(MARKS) if with_marks else None
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").encode().split()
            if len(words) < WINDOW:
                continue
            own = marks[i].values.to_numpy(zero_copy_only=False) if with_marks else None
            group.append((ids[i].as_py(), ties[i].as_py(), table.of(words), own))
            total += len(words)
            if total >= BATCH_WORDS:
                yield group
                group, total = [], 0
    if group:
        yield group
    del table, group
    give_back()


def _batch(keys: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = {"key": keys.view(np.int64), **columns}
    for start in range(0, len(keys), 100_000):
        part = slice(start, start + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in columns.values()], names=list(columns))


def _own_keys(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """A key per document, for rows that ask nothing."""
    return mix(mix(ids.view(np.uint64) + np.uint64(0x5EED)) + ties.view(np.uint64))


def _unsorted(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Back in document order, in which ids and positions compress well."""
    out = np.empty_like(values)
    out[order] = values
    return out


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors as (key, id, tie, 2 * position + known), known: repeated in this batch."""
    for group in _documents(batches):
        hashes, ids, ties, places = [], [], [], []
        for id, tie, words, _ in group:
            # 48 bits compress better; two anchors that seem equal only make more candidates
            h = window_hashes(words, ANCHOR) >> np.uint64(16)
            at = np.arange(len(h))
            at = at[np.isin(at % PERIOD, COVER)]
            hashes.append(h[at])
            places.append(at)
            ids.append(np.full(len(at), id, np.int64))
            ties.append(np.full(len(at), tie, np.int64))
        h, id, tie, at = map(np.concatenate, (hashes, ids, ties, places))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        later = np.concatenate([[False], same])
        known = _unsorted(order, later | np.concatenate([same, [False]]))
        key = np.where(_unsorted(order, later), _own_keys(id, tie), h)
        yield from _batch(key, id=id, tie=tie, place=at * 2 + known)


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around marked anchors as (key, id, tie, 2 * start + known), known: one that is
    equal starts earlier in this batch."""
    for group in _documents(batches, with_marks=True):
        hashes, ids, ties, places = [], [], [], []
        for id, tie, words, marks in group:
            n = len(words) - WINDOW + 1
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, np.maximum(marks - PERIOD + 1, 0), 1)
            np.add.at(change, np.minimum(marks + 1, n), -1)
            at = np.flatnonzero(np.cumsum(change[:n]) > 0)
            hashes.append(window_hashes(words, WINDOW)[at])
            places.append(at)
            ids.append(np.full(len(at), id, np.int64))
            ties.append(np.full(len(at), tie, np.int64))
        h, id, tie, at = map(np.concatenate, (hashes, ids, ties, places))
        order = np.lexsort((at, tie, id, h))
        later = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        head = order[np.maximum.accumulate(np.where(later, 0, np.arange(len(h))))]
        known = (id[order] != id[head]) | (tie[order] != tie[head]) | (at[order] != at[head])
        known = _unsorted(order, known)
        key = np.where(known, _own_keys(id, tie), h)
        yield from _batch(key, id=id, tie=tie, place=at * 2 + known)


def repeated_starts(keyed: DataFrame) -> DataFrame:
    """Starts of windows that also start earlier, per document of ``keyed``.

    The second pass takes all columns of ``keyed``: so its join by document shuffles what the
    caller's join with the result shuffles, and Spark does it once.
    """
    by_key = Window.partitionBy("key")
    place = F.shiftright("place", 1)
    known = F.col("place").bitwiseAND(1) == 1
    marks = (
        keyed.select(ID, TIE, TEXT)
        .mapInArrow(anchor_rows, _ROWS)
        .withColumn("n", F.count("*").over(by_key))
        .filter(known | (F.col("n") > 1))
        .groupBy(F.col("id").alias(ID), F.col("tie").alias(TIE))
        .agg(F.collect_list(place).alias(MARKS))
    )
    # Landed: the anchors' shuffle can be removed before the windows' begins.
    marks = land(marks, "marked-anchors")
    me = F.struct("id", "tie", place.alias("at"))
    return (
        keyed.join(marks, [ID, TIE])
        .mapInArrow(window_rows, _ROWS)
        .withColumn("first", F.min(me).over(by_key))
        .filter(known | (me > F.col("first")))
        .groupBy(F.col("id").alias(ID), F.col("tie").alias(TIE))
        .agg(F.collect_list(place).alias("_starts"))
    )


_CUT = (
    "struct<n_words:bigint,n_removed:bigint,spans:array<struct<start:bigint,length:bigint>>,kept:string>"
)


def cut_out(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for texts, all_starts in parts:
        counts, removed, spans, kept = [], [], [], []
        for text, starts in zip(texts, all_starts):
            words = (text.as_py() or "").encode().split()
            gone = np.zeros(len(words), bool)
            own = []
            if starts.is_valid and len(words) >= WINDOW:
                at = starts.values.to_numpy(zero_copy_only=False)
                at = at[at <= len(words) - WINDOW]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                own = [
                    {"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])
                ]
                words = [w for w, x in zip(words, gone.tolist()) if not x]
            counts.append(len(gone))
            removed.append(int(gone.sum()))
            spans.append(own)
            kept.append(b" ".join(words).decode())
        yield pa.StructArray.from_arrays(
            [pa.array(counts), pa.array(removed), pa.array(spans, kind), pa.array(kept, pa.string())],
            ["n_words", "n_removed", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``removed_spans`` (in words) and ``kept_text``."""
    order = F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID))
    again = docs.groupBy(order.alias(ID)).agg(F.count("*").alias("n")).filter("n > 1")
    bitmap = key_bitmap(again.select(F.xxhash64(ID)), SLOTS).scalar()
    tie = F.when(maybe_among(bitmap, F.xxhash64(order), SLOTS), F.xxhash64(order, text)).otherwise(
        F.lit(0).cast("bigint")
    )
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
    keyed = docs.select(order.alias(ID), tie.alias(TIE), F.col(text).alias(TEXT), rest.alias(REST))
    without = F.arrow_udf(cut_out, _CUT)
    cut = keyed.join(repeated_starts(keyed), [ID, TIE], "left").withColumn(
        "_cut", without(F.col(TEXT), F.col("_starts"))
    )
    found = {
        "n_words": F.col("_cut.n_words"),
        "n_removed": F.col("_cut.n_removed"),
        "removed_spans": F.col("_cut.spans"),
        "kept_text": F.col("_cut.kept"),
    }
    return cut.select(
        *(
            F.col(TEXT).alias(c) if c == text else F.col(REST)[c].alias(c)
            for c in docs.columns
            if c not in found
        ),
        *(column.alias(name) for name, column in found.items()),
    )

"""Hard negatives by inner product, with pruning by length and by sorted coordinates.

An anchor's positives are the rows of its label with the highest inner products; hard negatives
of a positive are the best rows of other labels whose score lies in a share of the positive's.
Components become integers, floor(scale * x), so scores are exact; ties go to the smaller id.

Both searches run over pairs of blocks: up to ``ANCHORS`` anchors against up to ``BLOCK`` rows of
one length level (a fixed geometric grid), dealt by hash, so neither a hot label nor a hot length
makes a large group.  Positives look only at blocks of their label.  For negatives an anchor knows
the least score it can use, and is sent only to levels long enough to reach it.

Inside a pair of blocks the rows lie in buckets of falling length, each with its rows' directions
sorted by every coordinate.  For an anchor the score still needed (the worst it would keep now, or
the lower end of its range) is a least cosine in the bucket.  With it, each focus coordinate (the
anchor's largest) leaves a range of values a row can have; the rows that lie in all these ranges of
the sorted lists are candidates and are scored exactly, in tiles of anchors of the same focus.

Rows with a null id, label or vector or with null, non-finite or very large components (squared
integer length from ``LIMIT`` on) take no part.  Rows are compared with rows of the same length
only.  Of rows that share an id, the one with the least label, then vector, counts.  Zero vectors
score 0 with all.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import land

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: per cent of the positive's score that a negative has, at least and at most
RANGE = (50, 95)
#: vectors of a larger squared length take no part: scores stay below 2 ** 48
LIMIT = 1 << 48
BLOCK = 4096
ANCHORS = 2048
BUCKET = 1024
FOCUS = 3
TILE = 64
#: levels per doubling of the squared length
STEPS = 4
NONE = -(1 << 48)
#: for rounding in angles and cosines
SLACK = 1e-7


def level_of(len2: Column) -> Column:
    """0 for the zero vector, then one level for each ``STEPS``-th of a doubling."""
    step = F.floor(F.log2(F.greatest(len2, F.lit(1))) * STEPS).cast("int") + 1
    return F.when(len2 == 0, 0).otherwise(step)


def longest(level: Column) -> Column:
    """No row of the level is longer."""
    return F.when(level == 0, 0.0).otherwise(F.pow(F.lit(2.0), (level + 0.001) / (2.0 * STEPS)))


class Bucket:
    """Rows of similar length, with their directions sorted by each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        length = np.sqrt((self.x * self.x).sum(axis=1))
        self.high, self.low = length.max(), length.min()
        unit = self.x / np.maximum(length, 1e-300)[:, None]
        by_value = np.argsort(unit, axis=0, kind="stable")
        #: a coordinate's values in order, and each row's place in that order
        self.values = np.take_along_axis(unit, by_value, axis=0)
        self.place = np.empty(unit.shape, np.int32)
        np.put_along_axis(
            self.place, by_value, np.arange(len(ids), dtype=np.int32)[:, None], axis=0
        )

    def candidates(
        self, need: np.ndarray, length: np.ndarray, unit: np.ndarray, focus: np.ndarray
    ) -> np.ndarray:
        """Which rows each anchor may score ``need`` or more with (anchors x rows)."""
        reach = np.where(need > 0, self.high, self.low) * length
        least = np.where(need == 0, 0.0, need / np.maximum(reach, 1e-300))
        # A zero row or anchor scores 0: only a need above 0 rules it out.
        least = np.where((reach == 0) & (need <= 0), -1.0, least)
        out = np.repeat((least <= 1 + 1e-9)[:, None], len(self.ids), axis=1)
        if self.low == 0:
            prune = least > 0
        else:
            prune = (least > -1) & (length > 0)
        open_ = np.arccos(np.clip(least, -1.0, 1.0)) + SLACK
        for k in range(focus.shape[1]):
            f = focus[:, k]
            angle = np.arccos(np.clip(unit[np.arange(len(f)), f], -1.0, 1.0))
            low = np.cos(np.minimum(angle + open_, np.pi)) - SLACK
            high = np.cos(np.maximum(angle - open_, 0.0)) + SLACK
            for c in np.unique(f):
                those = np.flatnonzero((f == c) & prune)
                start = np.searchsorted(self.values[:, c], low[those], "left")
                stop = np.searchsorted(self.values[:, c], high[those], "right")
                # Ranges that hold the whole list rule nothing out.
                some = (start > 0) | (stop < len(self.ids))
                those, start, stop = those[some], start[some], stop[some]
                place = self.place[:, c]
                out[those] &= (place >= start[:, None]) & (place < stop[:, None])
        return out


class Search:
    """The best rows so far of a block of anchors.

    Each anchor has ranges ``low <= score <= high``, padded with empty ones, and keeps the
    ``keep`` best rows of each.
    """

    def __init__(self, ids, labels, x, low, high, keep: int, same: bool):
        self.ids, self.labels, self.x = ids, labels, x
        self.low, self.high, self.keep, self.same = low, high, keep, same
        self.length = np.sqrt((x * x).sum(axis=1))
        self.unit = x / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.order = np.lexsort((self.unit[np.arange(len(x)), self.focus[:, 0]], self.focus[:, 0]))
        self.floor = np.where(low <= high, low, 1 << 49)
        none = np.zeros(0, np.int64)
        self.kept = (none, none, none)

    @property
    def need(self) -> np.ndarray:
        """The least score that can still matter to each anchor."""
        return self.floor.min(axis=1)

    def look(self, bucket: Bucket) -> int:
        """Take in a bucket's rows; how many were scored."""
        need, scored = self.need, 0
        found: list[tuple] = []
        for start in range(0, len(self.order), TILE):
            tile = self.order[start : start + TILE]
            mask = bucket.candidates(
                need[tile], self.length[tile], self.unit[tile], self.focus[tile]
            )
            same = bucket.labels[None, :] == self.labels[tile][:, None]
            mask &= same if self.same else ~same
            if self.same:
                mask &= bucket.ids[None, :] != self.ids[tile][:, None]
            rows = np.flatnonzero(mask.any(axis=0))
            if not len(rows):
                continue
            scored += int(mask.sum())
            # Whole numbers below 2 ** 53: exact in doubles.
            scores = self.x[tile] @ bucket.x[rows].T
            a, b = np.nonzero(mask[:, rows] & (scores >= need[tile][:, None]))
            found.append((tile[a], scores[a, b].astype(np.int64), bucket.ids[rows[b]]))
        if found:
            self._keep(*(np.concatenate(x) for x in zip(*found)))
        return scored

    def _keep(self, anchor: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        anchor, score, other = (
            np.concatenate(x) for x in zip(self.kept, (anchor, score, other))
        )
        if not len(anchor):
            return
        order = np.lexsort((other, -score, anchor))
        anchor, score, other = anchor[order], score[order], other[order]
        place = (anchor << 50) + ((1 << 49) - score)
        chosen = np.zeros(len(anchor), bool)
        everyone = np.arange(len(self.ids), dtype=np.int64)
        end = np.searchsorted(anchor, everyone, "right")
        for i in range(self.low.shape[1]):
            high = np.minimum(self.high[:, i], 1 << 48)
            first = np.searchsorted(place, (everyone << 50) + ((1 << 49) - high), "left")
            last = self.low[:, i]
            for k in range(self.keep):
                at = first + k
                inside = at < end
                at = np.minimum(at, len(anchor) - 1)
                inside &= score[at] >= last
                chosen[at[inside]] = True
                if k == self.keep - 1:
                    better = np.where(inside, score[at], self.low[:, i])
                    usable = self.low[:, i] <= self.high[:, i]
                    self.floor[usable, i] = np.maximum(self.floor[usable, i], better[usable])
        self.kept = anchor[chosen], score[chosen], other[chosen]


def search_block(rows, anchors, keep: int, same: bool) -> tuple[tuple, int]:
    """``rows``: ids, labels, vectors. ``anchors``: the same, lows, highs. What each anchor keeps."""
    search = Search(*anchors, keep, same)
    ids, labels, x = rows
    order = np.argsort(-(x * x).sum(axis=1), kind="stable")
    scored = 0
    for start in range(0, len(order), BUCKET):
        part = order[start : start + BUCKET]
        scored += search.look(Bucket(ids[part], labels[part], x[part]))
    anchor, score, other = search.kept
    return (search.ids[anchor], score, other), scored


def _search(keep: int, same: bool):
    def one(table: pa.Table) -> tuple:
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return ()
        ids = table.column("id").to_numpy()
        labels = table.column("label").to_numpy()
        v = table.column("v").combine_chunks()
        x = v.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        ends = []
        for name, fill in (("lows", 1), ("highs", 0)):
            lists = table.column(name).take(pa.array(right)).to_pylist()
            wide = np.full((len(right), max(map(len, lists))), fill, np.int64)
            for row, values in zip(wide, lists):
                row[: len(values)] = values
            ends.append(wide)
        rows = ids[left], labels[left], x[left]
        return search_block(rows, (ids[right], labels[right], x[right], *ends), keep, same)[0]

    def run(shard: pa.Table) -> pa.Table:
        block = shard.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        found = [one(shard.take(pa.array(part))) for part in np.split(order, cuts)]
        none = np.zeros(0, np.int64)
        columns = list(zip(*(f for f in found if f))) or [[none]] * 3
        names = ("anchor_id", "score", "other_id")
        return pa.table({name: np.concatenate(c) for name, c in zip(names, columns)})

    return run


_FOUND = "anchor_id bigint, score bigint, other_id bigint"


def _pairs(rows: DataFrame, anchors: DataFrame, key: tuple, keep: int, same: bool) -> DataFrame:
    """Search every anchor against the rows of its ``key`` (and of levels it can reach).

    A table with one row per key and level says in how many blocks both sides are dealt; rows go
    to each block of anchors, anchors to each block of rows.
    """
    some = anchors.groupBy(*key).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("n_anchor"))
    dealt = land(
        rows.groupBy(*key, "level")
        .agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_row"))
        .join(some, list(key)),
        "blocks",
    )
    # Small blocks share a call of the search.
    total = dealt.agg(F.sum(F.col("n") * F.col("n_anchor"))).first()[0] or 0
    shards = max(1, total * 4 // BLOCK)
    of = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("array<bigint>")
    block = F.xxhash64(*key, "level", "r", "a").alias("block")
    shown = (block, "side", "id", "label", "v", "lows", "highs")
    sent = (
        rows.join(dealt, [*key, "level"])
        .withColumns({"r": of("id", "n_row"), "side": F.lit(0), "lows": none, "highs": none})
        .select("*", each("n_anchor").alias("a"))
        .select(*shown)
    )
    least = F.array_min("lows")
    reach = F.sqrt(F.col("len2").cast("double")) * longest(F.col("level")) * (1 + 1e-9)
    asked = (
        anchors.drop("level")
        .join(dealt, list(key))
        .filter((least <= 0) | (reach >= least))
        .withColumns({"a": of("id", "n_anchor"), "side": F.lit(1)})
        .select("*", each("n_row").alias("r"))
        .select(*shown)
    )
    both = sent.unionByName(asked).withColumn("shard", F.pmod("block", F.lit(shards)))
    return both.groupBy("shard").applyInArrow(_search(keep, same), _FOUND)


def participants(
    vectors: DataFrame, id: str, vector: str, label: str | Column, scale: int
) -> DataFrame:
    """``id, label, v, dim, len2, level`` of the rows that take part, landed."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < 1e15)
    label = F.col(label) if isinstance(label, str) else label
    read = vectors.select(
        F.col(id).cast("bigint").alias("id"),
        label.cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("x"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0")
    whole = F.transform("x", lambda e: F.floor(e * scale).cast("double"))
    length = F.aggregate("w", F.lit(0.0), lambda a, e: a + e * e)
    once = (
        read.filter(F.forall("x", finite))
        .select("id", "label", whole.alias("w"))
        .filter(length < LIMIT)
        .groupBy("id")
        .agg(F.min(F.struct("label", F.transform("w", lambda e: e.cast("int")).alias("v"))).alias("r"))
    )
    exact = F.aggregate("r.v", F.lit(0).cast("bigint"), lambda a, e: a + e.cast("bigint") * e)
    return land(
        once.select(
            "id", "r.label", "r.v", F.size("r.v").alias("dim"), exact.alias("len2"),
            level_of(exact).alias("level"),
        ),
        "mined-rows",
    )


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Callable[[Column], Column],
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: tuple[int, int] = RANGE,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says of the id column which rows are anchors.
    """
    rows = participants(vectors, id, vector, label, scale)
    chosen = rows.filter(anchors(F.col("id")))
    all_scores = chosen.withColumns(
        {
            "lows": F.array(F.lit(NONE).cast("bigint")),
            "highs": F.array(F.lit(-NONE).cast("bigint")),
        }
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    found = _pairs(rows, all_scores, ("dim", "label"), positives, True)
    top = land(
        found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= positives),
        "positives",
    )
    least, most = share
    # least * p <= 100 * n <= most * p in whole numbers.
    floored = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    low, high = -floored(-F.col("score") * least), floored(F.col("score") * most)
    ranged = top.select(
        "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"),
        low.cast("bigint").alias("low"), high.cast("bigint").alias("high"),
    ).filter("low <= high")
    ranges = ranged.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_set(F.struct("low", "high")).alias("ranges")
    )
    asking = chosen.join(ranges, "id").select(
        *chosen.columns, F.col("ranges.low").alias("lows"), F.col("ranges.high").alias("highs")
    )
    met = _pairs(rows, asking, ("dim",), negatives, False)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    return (
        ranged.join(met, "anchor_id")
        .filter("score BETWEEN low AND high")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= negatives)
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("other_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )

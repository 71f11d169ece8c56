"""Near-duplicate documents by b-bit MinHash.

Each document has a set of shingles (runs of ``words`` words, letters A-Z lower-cased; a text
with fewer words is one shingle; without words the set is empty and links with nothing).
Documents with equal sets are folded to the smallest id.  Of each representative 160 minima
are taken: 32 bands of 5 give candidates, and the low 4 bits of the first 128 minima, packed
into words, give an estimate of the similarity by counting equal groups of bits, corrected
for chance collisions.  Pairs whose estimate is over five standard deviations too low are
left; all others are confirmed on the full sets.  A pair at the threshold of 0.8 is no
candidate with probability 5e-6.

Sets that are similar enough have sizes within the same ratio, so a bucket holds only sets of
neighbouring size classes.  A bucket is not expanded into pairs: each member is first paired
with three leaders of its bucket, the smallest id and two chosen by hash; the links found give
components, and only members of one bucket that are still in different components are compared,
so each candidate pair is either confirmed or already connected.  That comparison runs inside
tasks, over blocks of a bucket: a pair is taken up in the first bucket it shares, its bits are
counted, and those that may link are intersected on hashed sets (or on samples of them by hash,
for sets of over ``SAMPLE``).  Of the links found only what ties the block together leaves the
task, besides pairs too close to the threshold to tell, so no pair below it becomes a row.
Sets are made where the texts are read, for documents that a bitmap of fixed size lets through,
so texts are not shuffled.

Rows with a null id have ``n_shingles`` and are linked with nothing; they are kept.  Rows that
share an id are judged each by its own text.  Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
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
from tidewatch.llm.components import connected_components

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
BITS, PACKED = 4, 128
LONGS = PACKED // 64
#: words of 64 bits in the bitmap of ids whose sets are needed
SLOTS = 1 << 18
#: standard deviations below the threshold at which an estimate rules a pair out
MARGIN = 5.2
#: members compared with each other at a time, and rows of blocks that share a call
BLOCK, SHARD = 2048, 4096
#: bytes of bits that a block looks at together
GRID = 16 << 20
#: hashes shipped of a set, about, at most
SAMPLE = 2048
#: sets up to this size have no equal short hashes to speak of
FEW = 200


@dataclass(frozen=True)
class Similarity:
    """Words per shingle, and the similarity that links, in percent."""

    words: int = 5
    percent: int = 80


_SIGNATURE = "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, bits array<bigint>"


def shingle_set(text: str | None, words: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    found = table.of((text or "").encode().lower().split())
    if not len(found):
        return found
    return np.unique(window_hashes(found, min(words, len(found))) + np.uint64(min(words, len(found))))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    factors = random.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * 2 + np.uint32(1)
    return factors, random.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def minima(shingles: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of each hash function over the set."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):
        part = low[start : start + 1024, None] * seeds[0][None, :]
        part += seeds[1][None, :]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """Low bits of the first minima, one plane of bits after the other."""
    planes = [(values[:PACKED] >> np.uint32(j)) & np.uint32(1) for j in range(BITS)]
    return np.packbits(np.concatenate(planes).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, rule: Similarity) -> DataFrame:
    """``docs``: id and text. Set size, set key, band hashes and packed bits of each row."""
    words = rule.words

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seeds = WordHashes(), _seeds()
        powers = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(ROWS)], np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                out = ([], [], [], [], [])
                for text in part.column(1):
                    own = shingle_set(text.as_py(), words, table)
                    keys, bands, bits = (0, 0), None, None
                    if len(own):
                        again = mix(own + np.uint64(0x51ED2701))
                        keys = [int(x.sum().astype(np.int64)) for x in (own, again)]
                        values = minima(own, seeds)
                        rows = values.reshape(BANDS, ROWS).astype(np.uint64)
                        bands = mix((rows * powers).sum(axis=1, dtype=np.uint64)).view(np.int64)
                        bits = pack(values)
                    for column, value in zip(out, (len(own), *keys, bands, bits)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                    names=["id", "n", "k1", "k2", "bands", "bits"],
                )
        del table
        give_back()

    return docs.mapInArrow(sign, _SIGNATURE)


def shingle_sets(docs: DataFrame, rule: Similarity) -> DataFrame:
    """``docs``: id and text. The full set of each row."""
    words = rule.words

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                own = [shingle_set(t.as_py(), words, table).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles"]
                )
        del table
        give_back()

    return docs.mapInArrow(gather, "id bigint, shingles array<bigint>")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed bits: share of equal groups, less what chance makes equal."""
    unequal = F.lit(0)
    for word in range(LONGS):
        differ = F.lit(0).cast("bigint")
        for plane in range(BITS):
            at = plane * LONGS + word
            differ = differ.bitwiseOR(x[at].bitwiseXOR(y[at]))
        unequal = unequal + F.bit_count(differ)
    chance = 2.0**-BITS
    return ((PACKED - unequal) / PACKED - chance) / (1 - chance)


def lowest_estimate(rule: Similarity) -> float:
    """An estimate below this rules a pair out."""
    level = rule.percent / 100
    return level - MARGIN * (level * (1 - level) / PACKED) ** 0.5 / (1 - 2.0**-BITS)


def class_base(rule: Similarity) -> float:
    """Sizes in the ratio of the threshold are at most one class of this base apart."""
    return 100.1 / rule.percent


def sample_limit(size_class: int, rule: Similarity) -> int:
    """Short hashes below this are sampled, of sets of this size class or the one before."""
    smallest = class_base(rule) ** size_class
    return min(1 << 32, int(2**32 * SAMPLE / smallest))


def hashed_samples(docs: DataFrame, rule: Similarity) -> DataFrame:
    """``docs``: id and text. Short hashes of each row's set, sorted, as many as blocks may need."""
    base = math.log(class_base(rule))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for text in part.column(1):
                    own = shingle_set(text.as_py(), rule.words, table)
                    short = np.unique((own >> np.uint64(32)).astype(np.uint32))
                    if len(own):
                        limit = sample_limit(math.floor(math.log(len(own)) / base), rule)
                        short = short[: np.searchsorted(short, limit)] if limit < 1 << 32 else short
                    out.append(short.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.binary())], names=["id", "hashes"]
                )
        del table
        give_back()

    return docs.mapInArrow(gather, "id bigint, hashes binary")


def _matrix(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().view(kind).reshape(len(flat), -1)


def candidates(block: pa.Table, rule: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's rows that may link, are in different components, share no earlier bucket."""
    side = block.column("side").to_numpy()
    bits, bands = _matrix(block.column("bits")), _matrix(block.column("bands"))
    part, size, n = (block.column(c).to_numpy() for c in ("part", "size", "n"))
    ids = block.column("id").to_numpy()
    band, at = block.column("band")[0].as_py(), block.column("class")[0].as_py()
    inside = side[0] == 2
    left = np.arange(len(side)) if inside else np.flatnonzero(side == 0)
    right = left if inside else np.flatnonzero(side == 1)
    # unequal groups of bits that a similarity at the lowest estimate has
    lowest = lowest_estimate(rule)
    chance = 2.0**-BITS
    most = PACKED * (1 - (lowest * (1 - chance) + chance)) + 1e-9
    found = [(left[:0], left[:0])]
    for start in range(0, len(left), 64):
        rows = left[start : start + 64]
        unequal = np.zeros((len(rows), len(right)), np.int64)
        for word in range(LONGS):
            differ = np.zeros((len(rows), len(right)), np.uint64)
            for plane in range(BITS):
                column = plane * LONGS + word
                differ |= bits[rows, column, None] ^ bits[None, right, column]
            unequal += np.bitwise_count(differ)
        mask = (unequal <= most) & (part[rows, None] != part[None, right])
        mask &= np.maximum(size[rows, None], size[None, right]) == at
        small, large = np.minimum(n[rows, None], n[None, right]), np.maximum(n[rows, None], n[None, right])
        mask &= 100 * small >= rule.percent * large
        if inside:
            mask &= ids[rows, None] < ids[None, right]
        a, b = np.nonzero(mask)
        a, b = rows[a], right[b]
        if len(a) and band:
            fresh = np.ones(len(a), bool)
            for earlier in range(band):
                fresh &= bands[a, earlier] != bands[b, earlier]
            a, b = a[fresh], b[fresh]
        found.append((a, b))
    return tuple(np.concatenate(x) for x in zip(*found))


def shared_hashes(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the lists ``a`` and ``b`` stand for, by counting bits."""
    _, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    # What only one list holds is in no intersection.
    common = times > 1
    place, row = (np.cumsum(common) - 1)[place[common[place]]], row[common[place]]
    shared = np.zeros(len(a), np.int64)
    # A stretch of values at a time, so that the grid of bits stays small.
    width = max(1, min(int(common.sum()) // 64 + 1, GRID // (8 * len(lists))))
    step = max(1, GRID // (8 * width))
    for first in range(0, int(common.sum()), 64 * width):
        some = np.flatnonzero((place >= first) & (place < first + 64 * width))
        at = place[some] - first
        grid = np.zeros((len(lists), width), np.uint64)
        np.bitwise_or.at(grid, (row[some], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        for start in range(0, len(a), step):
            part = slice(start, start + step)
            both = grid[a[part]] & grid[b[part]]
            shared[part] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return shared


def tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links are needed to connect what all of them connect."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    needed = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            needed[k] = True
    return needed


def _blockwise(compare):
    """Apply ``compare`` to each block of a shard."""

    def run(shard: pa.Table) -> pa.Table:
        block = shard.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        none = np.zeros(0, np.int64)
        found = [(none, none)]
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                found.append(compare(shard.take(pa.array(rows))))
        x, y = (np.concatenate(column) for column in zip(*found))
        return pa.table({"x": x, "y": y})

    return run


def _may_link(rule: Similarity):
    """Block and id of the rows that are in any candidate pair."""

    def compare(block: pa.Table):
        some = np.unique(np.concatenate(candidates(block, rule)))
        ids = block.column("id").to_numpy()[some]
        return np.full(len(ids), block.column("block")[0].as_py(), np.int64), ids

    return _blockwise(compare)


def _links(rule: Similarity):
    """Pairs that tie a block together, and those too close to the threshold to tell."""
    level = rule.percent / 100

    def compare(block: pa.Table):
        a, b = candidates(block, rule)
        ids = block.column("id").to_numpy()
        if not len(a):
            return ids[:0], ids[:0]
        at = block.column("class")[0].as_py()
        limit = sample_limit(at, rule)
        lists = [np.frombuffer(x, np.uint32) for x in block.column("hashes").to_pylist()]
        if limit < 1 << 32:
            lists = [x[: np.searchsorted(x, limit)] for x in lists]
        shared = shared_hashes(lists, a, b)
        sizes = np.array([len(x) for x in lists])
        union = sizes[a] + sizes[b] - shared
        similar = shared / np.maximum(union, 1)
        if limit < 1 << 32:
            slack = MARGIN * np.sqrt(level * (1 - level) / np.maximum(union, 1)) + 1e-9
        else:
            slack = np.where(np.minimum(sizes[a], sizes[b]) > FEW, 1.5 / np.maximum(union, 1), 1e-9)
        sure = np.flatnonzero(similar >= level + slack)
        close = np.flatnonzero((similar >= level - slack) & (similar < level + slack))
        sure = sure[tied(len(ids), a[sure], b[sure])]
        keep = np.concatenate([sure, close])
        return ids[a[keep]], ids[b[keep]]

    return _blockwise(compare)


def within_buckets(pool: DataFrame, reps: DataFrame, docs: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs ``(a, b)`` of different components that connect all that links across the buckets.

    ``pool``: bucket, band, class, id, part.
    """
    sizes = pool.groupBy("bucket").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = (
        pool.join(land(sizes, "bucket-sizes"), "bucket")
        .withColumn("own", own)
        .select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(
            F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
            F.when(F.col("own") == F.col("other"), 2)
            .when(F.col("own") < F.col("other"), 0)
            .otherwise(1)
            .alias("side"),
            "band",
            "class",
            "id",
            "part",
        )
    )
    spread = land(spread, "bucket-blocks")
    size_class = F.floor(F.log(F.col("n")) / math.log(class_base(rule))).alias("size")
    known = reps.select("id", "n", size_class, "bits", "bands")

    def shards(rows: DataFrame) -> DataFrame:
        n = max(1, rows.count() // SHARD)
        return rows.join(known, "id").withColumn("shard", F.pmod("block", F.lit(n))).groupBy("shard")

    found = land(shards(spread).applyInArrow(_may_link(rule), "x bigint, y bigint"), "may-link")
    again = spread.join(found.withColumnsRenamed({"x": "block", "y": "id"}), ["block", "id"])
    again = land(again, "linking-blocks")
    needed = maybe_among(
        key_bitmap(again.select(F.xxhash64("id")), SLOTS).scalar(), F.xxhash64("id"), SLOTS
    )
    hashes = land(hashed_samples(docs.filter(needed & F.col("id").isNotNull()), rule), "hashed-sets")
    pairs = shards(again.join(hashes, "id")).applyInArrow(_links(rule), "x bigint, y bigint")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, rule: Similarity) -> DataFrame:
    """Of the pairs ``(a, b)``, those whose full sets are similar enough."""
    bits = reps.select("id", "bits")
    likely = land(
        pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a")
        .join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
        .filter(estimate(F.col("x"), F.col("y")) >= lowest_estimate(rule))
        .select("a", "b")
        .distinct(),
        "likely-pairs",
    )
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id"))
    needed = maybe_among(key_bitmap(wanted, SLOTS).scalar(), F.xxhash64("id"), SLOTS)
    sets = land(shingle_sets(docs.filter(needed & F.col("id").isNotNull()), rule), "shingle-sets")
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return (
        likely.join(y, "b")
        .join(x, "a")
        .select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("both"))
        .filter(100 * F.col("shared") >= rule.percent * (F.col("both") - F.col("shared")))
        .select("a", "b")
    )


def _between(links: DataFrame, parts: DataFrame) -> DataFrame:
    """The links as links between components."""
    x = parts.select(F.col("id").alias("a"), F.col("component").alias("x"))
    y = parts.select(F.col("id").alias("b"), F.col("component").alias("y"))
    return links.join(x, "a", "left").join(y, "b", "left").select(
        F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")
    )


def _joined(parts: DataFrame, of_parts: DataFrame) -> DataFrame:
    """Components after some of them are joined; a vertex without links is its own."""
    top = of_parts.select(F.col("id").alias("component"), F.col("component").alias("top"))
    inside = parts.join(top, "component", "left").select(
        "id", F.coalesce("top", "component").alias("component")
    )
    return inside.unionByName(of_parts.join(parts, "id", "left_anti"))


def near_duplicates(
    docs: DataFrame, rule: Similarity = Similarity(), id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = land(signatures(docs, rule), "signatures")
    linkable = signed.filter("n > 0 and id is not null")
    # Sides that sum up a key are landed first, so that both sides of the join are exchanges
    # and a key with very many rows is split.
    firsts = linkable.groupBy("n", "k1", "k2").agg(
        F.min("id").alias("first"), F.max("id").alias("last")
    )
    firsts = land(firsts.filter("first < last").drop("last"), "copied-sets")
    members = land(
        linkable.select("id", "n", "k1", "k2")
        .join(firsts, ["n", "k1", "k2"], "left")
        .select("id", "n", "k1", "k2", F.coalesce("first", "id").alias("rep")),
        "members",
    )
    own = members.filter("id = rep").select("id", "n", "k1", "k2").distinct()
    reps = land(
        signed.join(own, ["id", "n", "k1", "k2"], "left_semi").select("id", "n", "bands", "bits"),
        "reps",
    )
    size_class = F.floor(F.log(F.col("n")) / math.log(class_base(rule)))
    banded = (
        reps.select("id", size_class.alias("size"), F.posexplode("bands").alias("band", "value"))
        .select("id", "band", "value", F.explode(F.array("size", F.col("size") + 1)).alias("class"))
        .select("id", "band", "class", F.xxhash64("band", "value", "class").alias("bucket"))
    )
    by_hash = [F.min_by("id", F.xxhash64("id", F.lit(k))) for k in (1, 2)]
    shared = banded.groupBy("bucket").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.array(F.min("id"), *by_hash).alias("leads")
    )
    shared = land(shared.filter("low < high").select("bucket", "leads"), "shared-buckets")
    buckets = land(banded.join(shared, "bucket"), "buckets")
    led = buckets.select("id", F.explode("leads").alias("lead")).filter("id <> lead")
    first_pairs = land(
        led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(),
        "first-pairs",
    )
    links = land(confirmed(first_pairs, reps, docs, rule), "links-by-lead")
    parts = connected_components(links)

    labelled = buckets.join(parts, "id", "left").select(
        "bucket", "band", "class", "id", F.coalesce("component", "id").alias("part")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    mixed = land(mixed.filter("low < high").select("bucket"), "mixed-buckets")
    pool = land(labelled.join(mixed, "bucket"), "mixed-members")
    rest = land(within_buckets(pool, reps, docs, rule), "rest-pairs")
    if not rest.isEmpty():
        more = confirmed(rest, reps, docs, rule)
        parts = _joined(parts, connected_components(_between(more, parts), "x", "y"))
    labels = members.join(
        parts.withColumnsRenamed({"id": "rep", "component": "of_rep"}), "rep", "left"
    ).select("id", "n", F.coalesce("of_rep", "rep").alias("component_id"))
    alone = signed.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return labels.unionByName(alone).select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )

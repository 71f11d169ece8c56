"""Language-model scoring by context-tree weighting over the bytes of running text.

A text is the sequence of its words (letters A-Z lower-cased, runs without the six ASCII
blanks), a blank after each, and an end sign.  Every byte is predicted from the ``DEPTH`` bytes
before it, across blanks; what precedes a text counts as end signs.  Each byte is eight binary
decisions; every context of every decision has a Krichevsky-Trofimov estimate, and the
estimates of all depths from 0 to ``DEPTH`` are mixed with the weights of the tree.

A spelling is a context of full depth with the byte that follows, packed.  Spellings are counted
over all positions of all texts, folded per chunk, and sent to their buckets as packed arrays, a
row per chunk and bucket.  Those seen only in texts held out are nodes with no counts, so every
position has its spelling.  Subtrees of contexts that share their nearest ``TOP`` bytes are
computed each in one place: up to the node at depth ``TOP``, then, once the few levels above are
mixed on the driver, down.

Scores of a text are sums over its positions, its base over its words.  Spellings that make up at
least 1 / ``FREQUENT`` of all positions and words that make up 1 / ``FREQUENT_WORDS`` of all
tokens, at most that many, are shipped with the tasks.  How often all others occur in each of up
to ``TOGETHER`` texts goes to their buckets, packed, and meets their scores there; what leaves a
bucket is one sum per text, again packed.  A chunk of texts is known by its place and what it
holds: if rows come in another order when a task runs again, the job ends with an error.

Null texts are empty.  Repeated rows each count and get equal results.  Null ids stay null.  With
no training rows every estimate is the one without counts.  Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import land_and_release
from tidewatch.llm.context_tree import ADDED, DISTINCT, count_words, log_gamma, log_kt, words_of

DEPTH = 6
TOP = 3
FREQUENT = 1 << 22
FREQUENT_WORDS = 1 << 20
#: bytes handled together; a longer text is handled on its own
CHUNK = 4_000_000
#: texts scored together at most: their number fits a byte
TOGETHER = 256
#: spellings per group of subtrees, about
GROUP = 20_000
#: buckets, at least, and bytes of text for each beyond
BUCKETS, BUCKET_BYTES = 64, 1 << 27
END = b"\n"
_HALF = math.log(0.5)


def sequence(words: list[bytes]) -> bytes:
    return b"".join(w + b" " for w in words) + END


def positions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spelling at each position of the sequences, and the sequence it belongs to."""
    before = END * DEPTH
    whole = b"\0" + b"".join(before + t for t in texts)
    sizes = np.array([len(t) for t in texts])
    # Eight bytes up to each place as one number, of which the farthest is taken off.
    packed = np.ndarray(len(whole) - 7, ">u8", whole, strides=(1,)).astype(np.int64)
    packed &= (1 << 8 * (DEPTH + 1)) - 1
    starts = np.cumsum(sizes + DEPTH)[:-1]
    kept = np.ones(len(packed), bool)
    kept[(starts[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return packed[kept], np.repeat(np.arange(len(texts)), sizes)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[list]]:
    """Rows, the text last and as words and sequence, about ``CHUNK`` bytes and at most ``most``
    rows at a time."""
    part, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            *values, text = (v.as_py() for v in row)
            words = words_of(text)
            part.append([*values, words, sequence(words)])
            size += len(part[-1][-1])
            if size >= CHUNK or len(part) >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, of 8 bytes an entry: all first bytes, all second ones and so on."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8).T for a in arrays]
    return pa.compress(np.ascontiguousarray(np.concatenate(planes)), codec="zstd", asbytes=True)


def unpack(packed: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed, 8 * size * len(kinds), codec="zstd"), np.uint8)
    planes = planes.reshape(len(kinds), 8, size)
    return [np.ascontiguousarray(p.T).view(k).reshape(size) for p, k in zip(planes, kinds)]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal entries begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _bucket(spelling: np.ndarray, buckets: int) -> np.ndarray:
    """By the nearest ``TOP`` bytes: subtrees stay whole."""
    near = (spelling >> 8) & ((1 << 8 * TOP) - 1)
    return ((near * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % buckets


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of spellings and words where their scores meet the texts: each key on its own."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> 40) % buckets


def _dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, size and packed entries, for each bucket that has some."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    sizes = np.bincount(bucket.astype(np.int64))
    arrays = [a[order] for a in arrays]
    ends = np.cumsum(sizes)
    for at in np.flatnonzero(sizes):
        stretch = slice(ends[at] - sizes[at], ends[at])
        yield int(at), int(sizes[at]), pack(*(a[stretch] for a in arrays))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*batch.columns):
            yield tuple(v.as_py() for v in row)


_COUNTS = "bucket int, size bigint, packed binary"


def count_spellings(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs``: train and text.  Spellings by bucket, packed with how often each occurs in
    training and in all texts of a chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, CHUNK):
            packed, owner = positions([t for *_, t in part])
            packed <<= 1
            packed |= np.array([row[0] for row in part], np.int64)[owner]
            del owner
            packed.sort()
            starts = _runs(packed)
            n, kinds = np.diff(starts, append=len(packed)), packed[starts]
            del packed, starts
            train, kinds = kinds & 1, kinds >> 1
            starts = _runs(kinds)
            c, n, kinds = np.add.reduceat(n * train, starts), np.add.reduceat(n, starts), kinds[starts]
            yield _batch(list(_dealt(_bucket(kinds, buckets), kinds, c, n)), _COUNTS)

    return docs.mapInArrow(count, _COUNTS)


def _sum_up(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Spellings and their counts, sorted by spelling."""
    keys, *counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    starts = _runs(keys)
    return [keys[starts], *(np.add.reduceat(x[order], starts) for x in counts)]


_small = np.arange(4096.0)


class _Table:
    """Logs of gamma at small counts, made when first used."""

    half: np.ndarray | None = None
    one: np.ndarray | None = None


def block_log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``log_kt``; small counts, which are most, are looked up."""
    if _Table.half is None:
        _Table.half, _Table.one = log_gamma(_small + 0.5), log_gamma(_small + 1.0)
    both = zeros + ones
    few = both < len(_small)
    z, o = np.where(few, zeros, 0).astype(np.int64), np.where(few, ones, 0).astype(np.int64)
    out = _Table.half[z] + _Table.half[o] - math.log(math.pi) - _Table.one[z + o]
    many = ~few
    if many.any():
        out[many] = log_kt(zeros[many], ones[many])
    return out


class Subtrees:
    """Nodes of depths ``TOP`` to ``DEPTH`` over sorted spellings, level by level.

    Per depth and decision: the node of each spelling of that depth, and per node its first
    spelling, its parent, its estimate of a one, its block probability and its weight.
    """

    def __init__(self, spellings: np.ndarray, c: np.ndarray):
        keys, up = {DEPTH: spellings}, {}
        counts = {DEPTH: c.astype(float)}
        for d in range(DEPTH - 1, TOP - 1, -1):
            keys[d], up[d + 1] = np.unique(keys[d + 1] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            counts[d] = np.bincount(up[d + 1], counts[d + 1], len(keys[d]))
        self.keys = keys
        self.levels: dict[tuple[int, int], dict] = {}
        for d in range(DEPTH, TOP - 1, -1):
            for k in range(8):
                prefix = keys[d] >> (8 - k)
                new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
                node, first = np.cumsum(new) - 1, np.flatnonzero(new)
                bit = (keys[d] >> (7 - k)) & 1
                ones = np.bincount(node, counts[d] * bit, len(first))
                zeros = np.bincount(node, counts[d] * (1 - bit), len(first))
                block, weight = own, weight = block_log_kt(zeros, ones), np.ones(len(first))
                if d < DEPTH:
                    under = self.levels[d + 1, k]
                    under["parent"] = node[up[d + 1][under["first"]]]
                    below = np.bincount(under["parent"], under["block"], len(first))
                    block = np.logaddexp(own, below) + _HALF
                    weight = np.exp(own + _HALF - block)
                self.levels[d, k] = {
                    "node": node, "first": first, "bit": bit, "zeros": zeros, "ones": ones, "block": block,
                    "weight": weight, "one": (ones + 0.5) / (zeros + ones + 1),
                }

    def name(self, k: int) -> np.ndarray:
        """Context and place in the tree of a byte's bits, of the nodes at depth ``TOP``."""
        key = self.keys[TOP][self.levels[TOP, k]["first"]]
        return (key >> 8 << 8) | (1 << k) | ((key & 255) >> (8 - k))

    def log10(self, names: np.ndarray, sums: np.ndarray, rests: np.ndarray) -> np.ndarray:
        """Of each spelling, given the mixtures above ``TOP`` by sorted name."""
        total = np.zeros(len(self.keys[DEPTH]))
        for k in range(8):
            at = np.searchsorted(names, self.name(k) & ((1 << 8 * TOP) - 1))
            above, rest = sums[at], rests[at]
            for d in range(TOP, DEPTH + 1):
                level = self.levels[d, k]
                if d > TOP:
                    above, rest = above[level["parent"]], rest[level["parent"]]
                above = above + rest * level["weight"] * level["one"]
                rest = rest * (1 - level["weight"])
            level = self.levels[DEPTH, k]
            chance = above[level["node"]]
            total += np.log10(np.where(level["bit"] == 1, chance, 1 - chance))
        return total


def mix_top(
    names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, block: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names at depth ``TOP`` - 1 with what depths 0 to there give and leave over."""
    levels = []
    for d in range(TOP - 1, -1, -1):
        names, up = np.unique(names & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        zeros, ones, below = (np.bincount(up, x, len(names)) for x in (zeros, ones, block))
        own = log_kt(zeros, ones)
        block = np.logaddexp(own, below) + _HALF
        levels.append((names, up, np.exp(own + _HALF - block), (ones + 0.5) / (zeros + ones + 1)))
    above, rest = 0.0, 1.0
    for at in range(TOP - 1, -1, -1):
        _, _, weight, one = levels[at]
        if at < TOP - 1:
            up = levels[at + 1][1]
            above, rest = above[up], rest[up]
        above, rest = above + rest * weight * one, rest * (1 - weight)
    return levels[0][0], above, rest


_TREES = "bucket int, top int, size bigint, n bigint, packed binary"
_BY_NAME = np.int64, np.float64, np.float64, np.float64


def gather_trees(counted: DataFrame, buckets: int) -> DataFrame:
    """Per group of subtrees a row with its spellings and their counts, and one (``top``) with its
    nodes at depth ``TOP``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, folded, bucket = [], 0, 0, 0
        for bucket, size, packed in _rows(batches):
            parts.append(unpack(packed, size, np.int64, np.int64, np.int64))
            waiting += size
            if waiting > max(1_000_000, folded):
                parts = [_sum_up(parts)]
                waiting, folded = 0, len(parts[0][0])
        if not parts:
            return
        keys, c, n = _sum_up(parts)
        del parts
        near = (keys >> 8) & ((1 << 8 * TOP) - 1)
        order = np.argsort(near, kind="stable")
        starts = _runs(near[order])
        # Whole subtrees, cut where the next multiple of the size is passed.
        cuts = starts[_runs(starts // GROUP)]
        for stretch in np.split(order, cuts[1:]):
            stretch.sort()
            k, group = keys[stretch], n[stretch]
            trees = Subtrees(k, c[stretch])
            levels = [trees.levels[TOP, bit] for bit in range(8)]
            names = np.concatenate([trees.name(bit) for bit in range(8)])
            nodes = [np.concatenate([x[y] for x in levels]) for y in ("zeros", "ones", "block")]
            total = int(group.sum())
            rows = [
                (bucket, 0, len(k), total, pack(k, c[stretch], group)),
                (bucket, 1, len(names), 0, pack(names, *nodes)),
            ]
            yield _batch(rows, _TREES)

    return counted.repartitionById(buckets, "bucket").mapInArrow(gather, _TREES)


_MET = "part int, chunk bigint, kind int, size bigint, packed binary"
#: what a packed row holds: scores of spellings (rare or shipped), counts of words, occurrences
#: of both in texts of a chunk, sums over these texts, the texts of a chunk
SPELLINGS, SHIPPED, WORDS, IN_TEXTS, WORDS_IN_TEXTS, SUMS, TEXTS = range(7)
_NO_CHUNK = -1


def score_spellings(trees: DataFrame, least: int, buckets: int) -> DataFrame:
    """The mixture's probability of the byte after each context, as log10 by spelling; apart for
    those that occur ``least`` times and the others."""
    top = [
        unpack(packed, size, *_BY_NAME)
        for size, packed in _rows(trees.filter("top = 1").select("size", "packed").toArrow().to_batches())
    ]
    columns = (np.concatenate(x) for x in zip(*top)) if top else (np.zeros(0, k) for k in _BY_NAME)
    names, sums, rests = mix_top(*columns)
    del top, columns

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, packed in _rows(batches):
            keys, c, n = unpack(packed, size, np.int64, np.int64, np.int64)
            values = Subtrees(keys, c).log10(names, sums, rests)
            often = n >= least
            rest = keys[~often]
            rows = [
                (b, _NO_CHUNK, SPELLINGS, *row)
                for b, *row in _dealt(_spread(rest, buckets), rest, values[~often])
            ]
            if often.any():
                rows.append((0, _NO_CHUNK, SHIPPED, int(often.sum()), pack(keys[often], values[often])))
            yield _batch(rows, _MET)

    return trees.filter("top = 0").select("size", "packed").mapInArrow(down, _MET)


def _word_table(words: DataFrame, buckets: int) -> DataFrame:
    """``words``: key and c, packed by bucket."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c = (column.to_numpy() for column in batch.columns)
            rows = [(b, _NO_CHUNK, WORDS, *rest) for b, *rest in _dealt(_spread(key, buckets), key, c)]
            if rows:
                yield _batch(rows, _MET)

    return words.mapInArrow(table, _MET)


class _Hashes(dict):
    """Spark's 64-bit hashes of words; the memory it takes is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= DISTINCT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def _found(keys: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of ``kinds`` among sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(kinds), np.int64), np.zeros(len(kinds), bool)
    at = np.minimum(np.searchsorted(keys, kinds), len(keys) - 1)
    return at, keys[at] == kinds


def _base(c: np.ndarray, floor: float) -> np.ndarray:
    return np.log10((c + ADDED) / floor)


def _occurrences(
    spellings: tuple[np.ndarray, np.ndarray],
    words: tuple[np.ndarray, np.ndarray],
    floor: float,
    end: tuple[float, int],
    buckets: int,
):
    """Per chunk of at most ``TOGETHER`` texts a row with sums over what is shipped, and rows with
    how often all else occurs in each text, by bucket."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task = _Hashes(), TaskContext.get().partitionId()
        word_keys, word_base, word_known = words[0], _base(words[1], floor), words[1] > 0
        for number, part in enumerate(_chunks(batches, TOGETHER)):
            packed, owner = positions([t for *_, t in part])
            n_bytes = np.bincount(owner, minlength=len(part))
            pairs = (packed.view(np.uint64) << 8) | owner.view(np.uint64)
            del packed, owner
            pairs.sort()
            # The same where a task runs again on the same texts in the same order only.
            chunk = xxhash.xxh64_intdigest(b"%d %d" % (task, number) + pairs.tobytes()) >> 1
            starts = _runs(pairs)
            times, pairs = np.diff(starts, append=len(pairs)), pairs[starts]
            kinds, owner = (pairs >> 8).view(np.int64), (pairs & 255).view(np.int64)
            first = _runs(kinds)
            spans = np.diff(first, append=len(kinds))
            at, there = _found(spellings[0], kinds[first])
            rest = np.repeat(~there, spans)
            value = np.zeros(len(first))
            value[there] = spellings[1][at[there]]
            score = np.bincount(owner, np.repeat(value, spans) * times, len(part))
            kinds, pairs, times = kinds[rest], pairs[rest], times[rest]
            rows = [
                (b, chunk, IN_TEXTS, *row) for b, *row in _dealt(_spread(kinds, buckets), pairs, times)
            ]
            sizes = np.array([len(w) for *_, w, _ in part])
            own = np.fromiter(
                map(hashes.__getitem__, chain.from_iterable(w for *_, w, _ in part)), np.uint64, int(sizes.sum())
            ).view(np.int64)
            kinds, back = np.unique(own, return_inverse=True)
            pairs = (back << 8) | np.repeat(np.arange(len(part)), sizes)
            pairs.sort()
            starts = _runs(pairs)
            times, pairs = np.diff(starts, append=len(pairs)), pairs[starts]
            kind, owner = pairs >> 8, pairs & 255
            at, there = _found(word_keys, kinds)
            at, there = at[kind], there[kind]
            base = np.bincount(owner[there], word_base[at[there]] * times[there], len(part)) + end[0]
            known = np.bincount(owner[there], word_known[at[there]] * times[there], len(part)) + end[1]
            kind, owner, times = kinds[kind[~there]], owner[~there], times[~there]
            rows += [
                (b, chunk, WORDS_IN_TEXTS, *row)
                for b, *row in _dealt(_spread(kind, buckets), kind, owner, times)
            ]
            ids = [row[0] for row in part]
            columns = (
                np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.int64),
                sizes + 1, n_bytes, known.astype(np.int64), base, score,
                np.full(len(part), len({row[0] for row in rows})),
            )
            rows.append((chunk % buckets, chunk, TEXTS, len(part), pack(*columns)))
            yield _batch(rows, _MET)

    return occurrences


def _meet(floor: float):
    """Rows of a bucket, tables first: sums over each chunk's texts of what occurs in them."""

    def table(parts: list[list[np.ndarray]], *kinds: type) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]
        order = np.argsort(columns[0])
        return [x[order] for x in columns]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list] = {SPELLINGS: [], WORDS: []}
        sorted_: tuple | None = None
        out: list[tuple] = []
        now, sums = None, None

        def done() -> None:
            if now is not None:
                out.append((0, now, SUMS, TOGETHER, pack(*sums)))

        for chunk, kind, size, packed in _rows(batches):
            if kind == SPELLINGS:
                tables[kind].append(unpack(packed, size, np.int64, np.float64))
                continue
            if kind == WORDS:
                tables[kind].append(unpack(packed, size, np.int64, np.int64))
                continue
            if len(out) >= 500:
                yield _batch(out, _MET)
                out.clear()
            if kind == TEXTS:
                out.append((0, chunk, kind, size, packed))
                continue
            if sorted_ is None:
                keys, scores = table(tables[SPELLINGS], np.int64, np.float64)
                hashes, c = table(tables[WORDS], np.int64, np.int64)
                sorted_ = keys, scores, hashes, _base(c, floor), c > 0
                tables.clear()
            keys, scores, hashes, base, known = sorted_
            if chunk != now:
                done()
                now, sums = chunk, [np.zeros(TOGETHER), np.zeros(TOGETHER), np.zeros(TOGETHER, np.int64)]
            if kind == IN_TEXTS:
                pairs, times = unpack(packed, size, np.uint64, np.int64)
                at = np.searchsorted(keys, (pairs >> 8).view(np.int64))
                sums[1] += np.bincount((pairs & 255).view(np.int64), scores[at] * times, TOGETHER)
            else:
                kinds, owner, times = unpack(packed, size, np.int64, np.int64, np.int64)
                at = np.searchsorted(hashes, kinds)
                sums[0] += np.bincount(owner, base[at] * times, TOGETHER)
                sums[2] += np.bincount(owner, known[at] * times, TOGETHER).astype(np.int64)
        done()
        if out:
            yield _batch(out, _MET)

    return meet


_SCORED = "doc bigint, n_tokens bigint, n_bytes bigint, n_known bigint, base double, score double"


def _total(table: pa.Table) -> pa.Table:
    """The texts of a chunk with all their sums."""
    texts, sums = [], []
    for kind, size, packed in _rows(table.select(["kind", "size", "packed"]).to_batches()):
        if kind == TEXTS:
            texts.append(unpack(packed, size, *[np.int64] * 5, np.float64, np.float64, np.int64))
        else:
            sums.append(unpack(packed, size, np.float64, np.float64, np.int64))
    if len(texts) != 1 or len(sums) != texts[0][-1][0]:
        raise RuntimeError("texts came in another order when a task ran again")
    doc, no_doc, n_tokens, n_bytes, known, base, score, _ = texts[0]
    for more in sums:
        base, score, known = (x + y[: len(doc)] for x, y in zip((base, score, known), more))
    columns = pa.array(doc, mask=no_doc == 1), n_tokens, n_bytes, known, base, score
    return pa.table(list(map(pa.array, columns)), [x.split()[0] for x in _SCORED.split(", ")])


def score_texts(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``train``: whether a row may be learnt from.
    """
    rows = docs.select(
        F.col(id).cast("long").alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text")
    )
    sizes = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.count_if("train").alias("texts")
    ).first()
    texts, buckets = sizes["texts"], min(max(BUCKETS, sizes["size"] // BUCKET_BYTES), (1 << 16) - 1)
    counted = count_spellings(rows.select("train", "text"), buckets)
    trees = land_and_release(gather_trees(counted, buckets), "running-spellings")
    n = trees.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = land_and_release(score_spellings(trees, -(-n // FREQUENT), buckets), "running-scores")
    shipped = [
        unpack(packed, size, np.int64, np.float64)
        for size, packed in _rows(table.filter(F.col("kind") == SHIPPED).select("size", "packed").toArrow().to_batches())
    ]
    keys, values = map(np.concatenate, zip(*shipped)) if shipped else (np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(keys)
    spellings = keys[order], values[order]
    del shipped, keys, values, order

    words = land_and_release(count_words(rows.select("train", "text")), "words")
    sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.when(F.col("c") > 0, 1)).alias("v"),
    ).first()
    total = sums["c"] + texts
    floor = ADDED * (sums["v"] + (texts > 0) + 1) + total
    often = F.col("n") * FREQUENT_WORDS >= sums["n"]
    hashed = words.select(F.xxhash64("word").alias("key"), "c", "n")
    local = hashed.filter(often).select("key", "c").toArrow().sort_by("key")
    known = local["key"].to_numpy(), local["c"].to_numpy()
    del local

    end = (math.log10((texts + ADDED) / floor), int(texts > 0))
    met = (
        table.filter(F.col("kind") == SPELLINGS)
        .unionByName(_word_table(hashed.filter(~often).select("key", "c"), buckets))
        .unionByName(
            rows.select("doc", "text").mapInArrow(_occurrences(spellings, known, floor, end, buckets), _MET)
        )
        .repartitionById(buckets, "part")
        .sortWithinPartitions("chunk")
        .select("chunk", "kind", "size", "packed")
        .mapInArrow(_meet(floor), _MET)
    )
    scored = met.groupBy("chunk").applyInArrow(_total, _SCORED)
    return scored.select(
        F.col("doc").alias(id),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        (-F.col("score") / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )

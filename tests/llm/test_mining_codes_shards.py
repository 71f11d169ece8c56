"""Hard negatives, vector codes and shards against plain computations, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, prose
from tidewatch.llm import hard_negatives, sharding, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, code string, block int"


def vectors(n=400, dim=16, seed=3, clusters=6):
    """Clustered vectors of many lengths, with copies, ties, zeros and unusable rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for i in range(n):
        x = centres[i % clusters] + rng.normal(size=dim) * (0.15 if i % 3 else 1.0)
        x = x * 10 ** rng.uniform(-1, 1)
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(3))))
    for i in range(n, n + 30):  # copies, some with other labels
        rows.append((i, rows[i % 5][1], i % 3))
    rows += [(n + 40, [0.0] * dim, 1), (n + 50, [0.0] * dim, 2)]
    rows += [(n + 61, None, 1), (n + 62, [], 1), (n + 63, [math.nan] + [1.0] * (dim - 1), 1)]
    rows += [(n + 64, [math.inf] + [1.0] * (dim - 1), 1), (n + 65, [None] + [1.0] * (dim - 1), 1)]
    rows += [(n + 66, [1.0] * dim, None), (None, [1.0] * dim, 1), (n + 70, [1.0, 2.0], 1)]
    rows += [(n + 71, [3.0, -2.0], 2), (n + 100, [1.5, 1.0], 1)]
    return [(*r, "x", "y", 0) for r in rows]


def integers(x):
    return [math.floor(256 * v) for v in x]


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def mined(rows, every=10, positives=5, negatives=3):
    kept = [(i, integers(x), y) for i, x, y, *_ in rows if i is not None and y is not None and x and usable(x)]
    out = set()
    for a, ax, ay in kept:
        if a % every:
            continue
        scored = [
            (-sum(p * q for p, q in zip(ax, bx)), b, by)
            for b, bx, by in kept
            if b != a and len(bx) == len(ax)
        ]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == ay][:positives]:
            hard = [s for s in scored if s[2] != ay and 50 * -p <= 100 * -s[0] <= 95 * -p]
            for rank, (n, negative, _) in enumerate(hard[:negatives], 1):
                out.add((a, positive, rank, negative, -p, -n))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, buckets and tiles
        for name, value in (("BLOCK", 50), ("ANCHORS", 7), ("BUCKET", 16), ("TILE", 5)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    found = hard_negatives.mine_hard_negatives(
        spark.createDataFrame(rows, VECTORS), lambda i: i % 10 == 0
    )
    want = mined(rows)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 300


def test_hard_negatives_of_few_or_no_rows(spark):
    table = spark.createDataFrame(vectors(), VECTORS)
    none = hard_negatives.mine_hard_negatives(table.limit(0), lambda i: i % 10 == 0)
    assert none.count() == 0
    one_label = hard_negatives.mine_hard_negatives(table, lambda i: i % 10 == 0, label=F.lit(1))
    assert one_label.count() == 0
    twice = table.unionByName(table)
    found = hard_negatives.mine_hard_negatives(twice, lambda i: i % 10 == 0)
    assert {tuple(r) for r in found.collect()} == mined(vectors())


def test_pruned_rows_cannot_score_enough():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(280, 300, size=(600, 1)))
    x[:3] = 0
    x[100:140] = np.floor(x[100] + rng.normal(size=(40, 12)))
    anchors = np.concatenate([x[100:150], x[:1], np.floor(rng.normal(size=(10, 12)) * 90)])
    bucket = hard_negatives.Bucket(np.arange(600), np.zeros(600), x)
    length = np.sqrt((anchors**2).sum(axis=1))
    unit = anchors / np.maximum(length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :3]
    scores = anchors @ bucket.x.T
    for share in (-0.5, 0.0, 0.3, 0.8, 0.97, 1.0):
        need = np.floor(scores.max(axis=1) * share)
        some = bucket.candidates(need, length, unit, focus)
        assert not (scores >= need[:, None])[~some].any()
        if share > 0.9:
            assert some.mean() < 0.5  # and it does prune


def coded(rows, parts, entries, rounds):
    kept = [(i, integers(x), y) for i, x, y in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [
            [min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
            for _, v, _ in kept
        ]

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                members = [cut(v, p) for (_, v, _), a in zip(kept, at) if a[p][1] == k]
                if members:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    at = nearest()
    rows = [(i, bytes(k for _, k in a), sum(d for d, _ in a)) for (i, *_), a in zip(kept, at)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return collections.Counter(rows), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rounds", [0, 1, 2, 6])
def test_codes_equal_plain_lloyd(spark, rounds):
    rows = [r for r in vectors(160, 16) if usable(r[1]) and len(r[1]) == 16]
    odd = [(-5, [1.0, 2.0], 1), (901, [], 1), (902, [1e9] * 16, 1), (903, None, 1)]
    odd += [(904, [math.nan] * 16, 1), (905, [None] * 16, None)]
    table = spark.createDataFrame(rows + [(*r, "x", "y", 0) for r in odd], VECTORS)
    codes = vector_codes.compress_vectors(
        table.repartition(7), carry=("label", "score", "block"), parts=8, entries=12, rounds=rounds
    )
    want, digest = coded([r[:3] for r in rows], 8, 12, rounds)
    found = codes.rows.select("vec_id", "code", "error", "label", "score", "block").collect()
    whole = [r for r in found if r.code is not None]
    assert collections.Counter((r.vec_id, bytes(r.code), r.error) for r in whole) == want
    assert codes.digest() == digest
    assert {r.vec_id for r in found if r.code is None} == {-5, 901, 902}
    labelled = {r.vec_id: r for r in vector_codes.with_label_errors(codes.rows).collect()}
    sums = collections.Counter()
    for r in whole:
        sums[r.label] += r.error
    assert all(labelled[r.vec_id].label_error == sums[r.label] for r in whole)
    back = vector_codes.decode(codes.rows.select("vec_id", "code"), codes.books).collect()
    ints = {r[0]: integers(r[1]) for r in rows}
    for r in back:
        if r.code is None:
            assert r.decoded is None
        elif r.vec_id is not None:
            far = sum((a - b) ** 2 for a, b in zip(r.decoded, ints[r.vec_id]))
            assert far == labelled[r.vec_id].error


def test_codes_of_no_rows(spark):
    codes = vector_codes.compress_vectors(spark.createDataFrame([], VECTORS), carry=("label",))
    assert codes.rows.count() == 0 and codes.books.size == 0


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, size=(3000, 3))
    book = rng.integers(-9, 9, size=(40, 3))
    entry, far, full = vector_codes.assign(x, book)
    assert full == 3000 * 40
    for share in (0.0, 0.05, 0.5, 1.0):
        moved = rng.random(40) < share
        after = np.where(moved[:, None], rng.integers(-9, 9, size=(40, 3)), book)
        moved = (after != book).any(axis=1)
        got, near, cost = vector_codes.assign(x, after, moved, entry, far)
        want, least, _ = vector_codes.assign(x, after)
        assert (got == want).all() and (near == least).all()
        assert cost <= full and (share > 0.05 or cost < full / 4)


def even_cuts(sizes, shards):
    """Each shard in turn gets the least capacity that lets the rest fit, by trying all cuts."""

    def largest(start, k):  # the least largest shard of sizes[start:] in k shards
        if k == 1:
            return sum(sizes[start:])
        return min(
            max(sum(sizes[start:end]), largest(end, k - 1)) for end in range(start, len(sizes) + 1)
        )

    cuts, start = [0], 0
    for k in range(shards, 0, -1):
        capacity, end = largest(start, k) if start < len(sizes) else 0, start
        while end < len(sizes) and sum(sizes[start : end + 1]) <= capacity:
            end += 1
        cuts.append(end)
        start = end
    return cuts


def test_cuts_are_minimax():
    pick = random.Random(4)
    for _ in range(60):
        groups = [(pick.choice((1, 2, 3, 7, 20, 60)), pick.choice((1, 2))) for _ in range(pick.randrange(0, 9))]
        groups = sorted(((s * c, c) for s, c in groups), key=lambda g: (-g[0], g[1]))
        kinds = collections.Counter(groups)
        table = sharding.Kinds(*(np.array(x, np.int64) for x in (
            [k[0] for k in kinds], [k[1] for k in kinds], list(kinds.values()))))
        shards = pick.randrange(1, 5)
        cuts = table.cuts(shards)
        assert cuts == even_cuts([g[0] for g in groups], shards)
        for cut in cuts:
            assert table.before(cut, "bytes") == sum(g[0] for g in groups[:cut])
            assert table.before(cut, "rows") == sum(g[1] for g in groups[:cut])


def checked_shards(rows, found, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert len(found) == len(rows)
    want = collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    assert {(r.law, r.grown_shard) for r in found} <= {("bytes", None)}
    for k in range(shards):
        slots = sorted(r.slot for r in found if r.shard == k)
        assert slots == list(range(len(slots)))
    return collections.Counter({k: sum(r["size"] for r in found if r.shard == k) for k in range(shards)})


def test_shards_of_documents(spark):
    docs = frame(spark, clash={"label": "x"})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sharding.shard_documents(docs, 4, carry=("text",)).collect()
    checked_shards(rows, found, 4)
    homes = collections.defaultdict(set)
    for r in found:
        homes[r.text or ""].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    with pytest.raises(ValueError):
        sharding.shard_documents(docs.withColumn("slot", F.lit(1)), carry=("slot",))


def test_shards_are_even_beside_a_hot_group(spark):
    hot = prose(1, 40)
    rows = [(None if i % 5 == 0 else i, hot) for i in range(400)]
    rows += [(1000 + i, prose(100 + i, 20 + i % 30)) for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = checked_shards(rows, sharding.shard_documents(table, 8).collect(), 8)
    (_, first), *rest = sorted(sizes.items())
    assert first == 400 * (len(hot) + 1)
    most = max(n for _, n in rest)
    assert most - min(n for _, n in rest) < 800 and most < first


def test_few_groups_and_none(spark):
    table = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, "")], "doc_id bigint, text string")
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(table).collect()}
    assert found == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (1, 1)}
    assert sharding.shard_documents(table.limit(0)).count() == 0


def test_written_shards_read_back(spark, tmp_path):
    docs = frame(spark).filter("text is not null")
    sharding.write_shards(sharding.shard_documents(docs, 3, carry=("text",)), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == docs.count() and {r.shard for r in back.collect()} == {0, 1, 2}

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, frame, prose
from tidewatch.llm import (
    components,
    decontamination,
    embedding_dedup,
    near_dedup,
    substring_dedup,
)


def _components(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    pick = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(50, 50), (60, 61), (61, 60)]
    links += [(pick.randrange(200, 260), pick.randrange(200, 260)) for _ in range(40)]
    table = spark.createDataFrame([*links, (None, 3)], "x bigint, y bigint")
    got = {r["id"]: r["component"] for r in components.connected_components(table, "x", "y").collect()}
    ids = {i for a, b in links for i in (a, b) if a != b}
    assert got == {i: c for i, c in _components({i for l in links for i in l}, links).items() if i in ids}
    assert components.connected_components(table.limit(0), "x", "y").count() == 0


def _sets(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    n = min(words, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def _near(rows, words):
    sets = {i: _sets(t, words) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, _components(ids, links)


def _near_copies():
    """A chain of texts each near the next, copies, and noise."""
    pick = random.Random(11)
    words = prose(20, 90).split()
    rows = []
    for i in range(60):
        words[pick.randrange(len(words))] = f"w{i}"
        rows.append((100 + i, " ".join(words), "en", "s", 1))
    rows += [(200 + i, prose(300 + i, 40), "en", "s", 1) for i in range(20)]
    rows += [(300 + i, rows[5][1], "en", "s", 1) for i in range(5)]
    return documents() + rows


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rows = _near_copies()
    docs = frame(spark, rows, clash={"n_shingles": "x", "component_id": "y", "kept": "z", "id": "q"})
    out = near_dedup.near_duplicates(docs, near_dedup.Similarity(words=words)).collect()
    sets, parts = _near(rows, words)
    assert len(out) == len(rows)
    for row in out:
        i = row["doc_id"]
        if i is None:
            assert row["component_id"] is None and row["kept"]
            continue
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[i]), parts[i], parts[i] == i)


def test_near_duplicates_of_no_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_bits_estimate_the_similarity(spark):
    table, seeds = near_dedup.WordHashes(), near_dedup._seeds()
    a = " ".join(f"w{i}" for i in range(1000))
    rows = []
    for shared in (1000, 900, 700, 300, 0):
        b = " ".join(f"w{i}" if i < shared else f"v{i}" for i in range(1000))
        x, y = (near_dedup.shingle_set(t, 1, table) for t in (a, b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        bits = [near_dedup.pack(near_dedup.minima(s, seeds)).tolist() for s in (x, y)]
        rows.append((true, *bits))
    got = spark.createDataFrame(rows, "true double, x array<bigint>, y array<bigint>").select(
        "true", near_dedup.estimate(F.col("x"), F.col("y")).alias("found")
    )
    for row in got.collect():
        assert abs(row["true"] - row["found"]) < 0.15


def _cut(rows, width=substring_dedup.WINDOW):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, words = {}, []
    for i, text, *_ in order:
        own = (text or "").encode().split()
        words.append((i, own))
        for at in range(len(own) - width + 1):
            first.setdefault(tuple(own[at : at + width]), (i, at))
    out = collections.defaultdict(set)
    for i, own in words:
        gone = [False] * len(own)
        for at in range(len(own) - width + 1):
            if first[tuple(own[at : at + width])] != (i, at):
                gone[at : at + width] = [True] * width
        kept = b" ".join(w for w, x in zip(own, gone) if not x).decode()
        out[i].add((len(own), sum(gone), kept))
    return out


@pytest.mark.parametrize("batch", [200, substring_dedup.BATCH_WORDS])
def test_repeats_equal_brute_force(spark, batch, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", batch)
    rows = _near_copies()
    passage = prose(70, 21)
    rows += [(400 + i, f"{prose(500 + i, 7 + i)} {passage} {prose(600 + i, 9)}", "en", "s", 1) for i in range(30)]
    rows.append((500, "again " * 100, "en", "s", 1))
    docs = frame(spark, rows, clash={"kept_text": "x", "n_words": "y", "doc": "z", "starts": "q"})
    out = substring_dedup.remove_repeats(docs.repartition(4)).collect()
    want = _cut(rows)
    assert len(out) == len(rows)
    for row in out:
        assert (row["n_words"], row["n_removed"], row["kept_text"]) in want[row["doc_id"]]
        assert sum(s["length"] for s in row["removed_spans"]) == row["n_removed"]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_cover_takes_any_two_positions_onto_it():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    for a in range(period):
        for b in range(period):
            assert any((a + s) % period in cover and (b + s) % period in cover for s in range(period))


def test_masks_hit_every_overlap_with_two_substitutions():
    import itertools

    for wrong in itertools.combinations(range(13), 2):
        assert any(
            not {at + k for k in mask} & set(wrong)
            for mask in decontamination.MASKS
            for at in range(13 - decontamination.SPAN + 1)
        )


def _overlaps(docs, items):
    tokens = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    found = {}
    for i, text, *_ in docs:
        own = tokens(text)
        for j, item in items:
            it = tokens(item)
            for shift in range(-len(it) + 1, len(own)):
                now = best = 0
                for k in range(max(0, -shift), min(len(it), len(own) - shift)):
                    now = max(0, now + (1 if it[k] == own[k + shift] else -decontamination.PENALTY))
                    best = max(best, now)
                if len(it) >= decontamination.SPAN and best >= min(decontamination.LEAST, len(it)):
                    found[i, j] = max(found.get((i, j), 0), best)
    return found


def test_decontamination_equals_brute_force(spark):
    items = [(0, prose(800, 15)), (1, prose(801, 40)), (2, prose(802, 9)), (3, "short one"), (4, None), (5, "")]
    changed = items[1][1].split()
    changed[12] = changed[25] = "other"
    docs = [
        (1, prose(1, 20) + " " + items[0][1].upper() + "! " + prose(2, 9), "en", "s", 1),
        (2, " ".join(changed), "en", "s", 1),
        (3, " ".join(items[1][1].split()[5:25]), "en", "s", 1),
        (4, prose(5, 60), "en", "s", 1),
        (5, items[2][1], None, None, None),
        (6, None, None, None, None),
        (7, "", "en", "s", 0),
        (8, prose(6, 5000) + " " + items[1][1], "en", "s", 0),
        (9, "short one", "en", "s", 0),
        (None, items[1][1], "en", "s", 0),
    ]
    bench = spark.createDataFrame([*items, (9, items[1][1])], "item_id bigint, text string").withColumn("doc", F.lit(1))
    frame_ = frame(spark, [*docs, docs[0]], clash={"overlap": "x", "hashes": "y", "item": "z"})
    out = decontamination.decontaminate(frame_, bench).collect()
    want = _overlaps(docs, items)
    assert len(out) == len(docs) + 1
    for row in out:
        mine = [v for (i, _), v in want.items() if i == row["doc_id"]]
        assert (row["contaminated"], row["n_items"], row["best_overlap"]) == (bool(mine), len(mine), max(mine, default=0))
    assert decontamination.decontaminate(frame_, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.decontaminate(frame_.limit(0), bench).count() == 0


def test_decontamination_plan_has_no_python(spark):
    bench = spark.createDataFrame([(0, prose(800, 15))], "item_id bigint, text string")
    plan = decontamination.decontaminate(frame(spark), bench)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def _vectors():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 24))
    rows = []
    for i in range(300):
        rows.append((i, (centres[i % 12] + draw.normal(0, 0.12, 24)).tolist()))
    rows += [(300 + i, draw.normal(size=24).tolist()) for i in range(200)]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (602, None), (603, []), (604, [0.0] * 24)]
    rows += [(605, [float("nan")] + [1.0] * 23), (606, [None] + [1.0] * 23), (607, [1.0, 2.0]), (608, [2.0, 4.0])]
    rows += [(609, [float("inf")] + [1.0] * 23), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [16, 512])
def test_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = _vectors()
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    table = table.withColumn("rep", F.lit("x")).withColumn("n_links", F.lit("y"))
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(table).collect()}
    assert len(out) == len(rows)
    fine = {
        i: np.array(v) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v)
    }
    links = [
        (a, b) for a in fine for b in fine
        if a < b and len(fine[a]) == len(fine[b])
        and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.9
    ]
    count = collections.Counter(i for link in links for i in link)
    assert sum(out[i]["n_links"] for i in fine) >= 0.98 * sum(count.values())
    assert all(out[i]["n_links"] <= count[i] for i in fine)
    parts = _components([i for i, _ in rows if i is not None], links)
    assert sum(out[i]["component_id"] == c for i, c in parts.items()) >= 0.98 * len(parts)
    for i in (602, 603, 604, 605, 606, 609):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert out[607]["n_links"] == out[608]["n_links"] == 1
    assert (out[None]["n_links"], out[None]["component_id"], out[None]["kept"]) == (0, None, True)
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    packed, factors = embedding_dedup.codes(x)
    rotated = x @ embedding_dedup.rotation(64).T
    estimate = embedding_dedup.unpack(packed, 64) @ rotated.T / factors[:, None]
    error = estimate - x @ x.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= embedding_dedup.bounds(factors, 64)[:, None]).all()

"""Families of documents that are close to the threshold, mostly below it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, prose
from tests.llm.test_dedup_operators import _components, _sets
from tidewatch.llm import near_dedup
from tidewatch.llm.common import WordHashes
from tidewatch.llm.near_dedup import Similarity


def family(seed: int, members: int, words: int, share: float) -> list[str]:
    """Copies of a text with up to ``share`` of the words changed."""
    pick = random.Random(seed)
    base = [f"{w}{k}" for k, w in enumerate(prose(seed, words).split())]
    out = []
    for m in range(members):
        text = list(base)
        for at in pick.sample(range(words), pick.randrange(int(words * share) + 1)):
            text[at] = f"new{pick.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def links_of(texts, words):
    sets = [_sets(t, words) for t in texts]
    return {
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }


@pytest.mark.parametrize("block", [7, 512])
def test_components_of_families(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = family(1, 90, 120, 0.12) + family(2, 60, 40, 0.1) + family(3, 20, 9, 0.4)
    random.Random(4).shuffle(texts)
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rule = Similarity(words=2)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), rule)
    links = links_of(texts, 2)
    assert 300 < len(links) < len(texts) ** 2 / 4
    assert {r.doc_id: r.component_id for r in got.collect()} == _components(range(len(texts)), links)


def as_block(texts, rule, size_class, side=2, band=0, parts=None):
    table, seeds = WordHashes(), near_dedup._seeds()
    rows = []
    for i, text in enumerate(texts):
        own = near_dedup.shingle_set(text, rule.words, table)
        values = near_dedup.minima(own, seeds)
        short = np.unique((own >> np.uint64(32)).astype(np.uint32))
        size = int(np.floor(np.log(len(own)) / np.log(near_dedup.class_base(rule))))
        limit = near_dedup.sample_limit(size, rule)
        bands = values.reshape(near_dedup.BANDS, near_dedup.ROWS)[:, 0].astype(np.int64) + i
        rows.append(
            dict(
                block=1, side=side, band=band, id=i, part=i if parts is None else parts[i], size=size,
                n=len(own), bits=near_dedup.pack(values), bands=bands,
                hashes=short[: np.searchsorted(short, limit)].tobytes(),
            )
        )
        rows[-1]["class"] = size_class
    return pa.Table.from_pylist(rows)


@pytest.mark.parametrize("sample", [40, 2048])
def test_links_of_a_block_connect_what_all_links_connect(monkeypatch, sample):
    monkeypatch.setattr(near_dedup, "SAMPLE", sample)
    rule = Similarity(words=2)
    texts = family(5, 80, 300, 0.09)
    sizes = {len(_sets(t, 2)) for t in texts}
    at = int(np.floor(np.log(max(sizes)) / np.log(near_dedup.class_base(rule))))
    links = {
        (a, b)
        for a, b in links_of(texts, 2)
        if max(np.floor(np.log(len(_sets(texts[k], 2))) / np.log(near_dedup.class_base(rule))) for k in (a, b)) == at
    }
    assert 100 < len(links)
    found = near_dedup._links(rule)(as_block(texts, rule, at))
    pairs = {(min(a, b), max(a, b)) for a, b in zip(found["x"].to_pylist(), found["y"].to_pylist())}
    kept = pairs & links  # what is confirmed later
    ids = range(len(texts))
    assert _components(ids, kept) == _components(ids, links)
    if sample == 2048:
        assert len(pairs) < 3 * len(texts)
    some = near_dedup._may_link(rule)(as_block(texts, rule, at))
    assert {k for pair in links for k in pair} <= set(some["y"].to_pylist())
    same = near_dedup._links(rule)(as_block(texts, rule, at, parts=[0] * len(texts)))
    assert same.num_rows == 0

from __future__ import annotations

from tests.llm.helpers import SCHEMA
from tidewatch.llm import decontamination


def _item(name: str, n: int) -> list[str]:
    return [f"{name}{i}" for i in range(n)]


def _put(words: list[str], *places: int) -> str:
    changed = ["other" if i in places else w for i, w in enumerate(words)]
    return "before it " + " ".join(changed) + " after it"


def test_overlaps_the_seeds_promise_are_accepted(spark):
    sizes = {1: 15, 2: 17, 3: 8, 4: 12, 5: 3, 6: 60, 7: 1}
    items = {i: _item(f"i{i}x", n) for i, n in sizes.items()}
    hit = [
        (10, _put(items[1], 5, 9)), (11, _put(items[2], 4, 12)), (20, _put(items[4], 6)), (21, _put(items[5])),
        (22, _put(items[6], *range(3, 60, 4))), (23, _put(items[7])), (24, _put(items[6][20:33], 4, 8)),
    ] + [(30 + k, _put(items[3], k)) for k in range(8)]
    clean = [
        (50, _put(items[3], 2, 5)), (51, _put(items[5], 1)), (52, _put(items[4], 3, 8)), (53, " ".join(items[6][49:])),
        (54, _put(items[6][20:33], 3, 6, 9)), (55, ""), (56, None),
    ]
    rows = [(i, t, "en", "s", 1) for i, t in hit + clean]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    out = decontamination.decontaminate(spark.createDataFrame(rows, SCHEMA), bench, whole=True).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"] for r in out if r["contaminated"]} == {i for i, _ in hit}


def test_short_items_of_ordinary_words_are_no_sign(spark):
    rows = [(i, f"the word number{i} of the text", "en", "s", 1) for i in range(30)]
    rows += [(100, "a rareword here", "en", "s", 1), (None, "it has rareword too", "en", "s", 1)]
    bench = spark.createDataFrame([(1, "The"), (2, "of the"), (3, "rareword"), (4, " ")], "item_id bigint, text string")
    out = decontamination.decontaminate(spark.createDataFrame(rows, SCHEMA), bench, whole=True).collect()
    assert {r["doc_id"] for r in out if r["contaminated"]} == {100, None}


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = " ".join(_item("w", 30))
    rows = [(None, item, "en", "s", 1), (None, "clean text", "en", "s", 1), (7, item, "en", "s", 1)]
    rows += [(7, "clean too", "en", "s", 1), (7, item, "en", "s", 1), (None, None, "en", "s", 1)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    out = decontamination.decontaminate(docs, bench, whole=True).collect()
    assert len(out) == len(rows)
    assert sorted(((r["doc_id"] or 0, r["contaminated"]) for r in out)) == [
        (0, False), (0, False), (0, True), (7, False), (7, True), (7, True),
    ]
    assert {r["n_items"] for r in out if r["contaminated"]} == {1}

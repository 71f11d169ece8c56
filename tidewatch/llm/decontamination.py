"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over ``SPAN`` consecutive tokens that ignores some positions.  Seeds of
all benchmark items and of all documents are hashed and joined; around each hit, document and
item are laid over each other and the overlap is scored: a match counts 1, a substitution
-``PENALTY``, and the best run must reach ``LEAST`` (all tokens of a shorter item).  The two
masks together hit every overlap of 13 tokens with up to two substitutions, and hence every
run of 12 equal tokens; the third hits where every fourth token is replaced.  Only DataFrame
functions are used.

With ``whole``, an overlap also counts if ``OVERLAP`` tokens of it in a row, or a shorter item as
a whole, have no more substitutions than the seeds allow: two in 13, one in items of 8 to 12, none
in items below ``SPAN``.  Items shorter than ``OVERLAP`` are then searched by runs, whole ones below
``SPAN`` and halves from there on, one of which a single substitution leaves as it is.

Tokens are runs of letters and digits in lower case.  Before the join, seeds of documents are
looked up in a bitmap of fixed size that holds the benchmark's seeds; what it lets through is
joined in full, so a bitmap filled by a huge benchmark costs time and no result.

Items with equal tokens count as one (smallest id).  Null and empty texts match nothing, nor,
without ``whole``, do items of fewer tokens than ``SPAN``.  Items below ``SHORT`` tokens that are in
more documents than ``RARE`` of all (and than ``FEW``) are ordinary language, and so few tokens no
sign that the item was there: they match nothing.  Each row of documents is judged by its own text, with or without an id; a hash
of both tells rows apart (``row_key``), and equal rows have equal results.  Other columns are left
out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import key_bitmap, land, maybe_among

#: offsets that count, per mask
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7), (0, 1, 2, 4, 5, 6))
SPAN = 8
#: tokens in a row of which the seeds allow two to differ
OVERLAP = 13
LEAST = 12
PENALTY = 2
#: items of fewer tokens count only where they are rare: in this share of documents, or so many
SHORT, RARE, FEW = 4, 0.001, 10
#: words of 64 bits in the bitmap
SLOTS = 1 << 16


def tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(hashed: DataFrame, id: str) -> DataFrame:
    """``(id, at, seeds)``: the seed hashes, one per mask, at each position."""
    last = F.size("hashes") - (SPAN - 1)
    shifted = [F.slice("hashes", F.lit(k + 1), last).alias(f"t{k}") for k in range(SPAN)]
    at = (
        hashed.filter(last > 0)
        .select(id, F.posexplode(F.arrays_zip(*shifted)).alias("at", "t"))
    )
    return at.select(
        id,
        "at",
        *(
            F.xxhash64(F.lit(m), *(F.col("t")[f"t{k}"] for k in mask)).alias(f"s{m}")
            for m, mask in enumerate(MASKS)
        ),
    )


_SEEDS = [f"s{m}" for m in range(len(MASKS))]


def _run(hashes: Column, at: Column, length: int | Column) -> Column:
    """Hash of a run of tokens, told apart from the masks' by its length."""
    return F.xxhash64(F.slice(hashes, at + 1, length))


def run_seeds(hashed: DataFrame, id: str, lengths: list[int]) -> DataFrame:
    """``(id, at, seed)``: the runs of the given lengths at each position."""

    def of_length(n: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("hashes") - n),
            lambda at: F.struct(at.alias("at"), _run(F.col("hashes"), at, n).alias("seed")),
        )

    none = F.array().cast("array<struct<at:int,seed:bigint>>")
    runs = [F.when(F.size("hashes") >= n, of_length(n)).otherwise(none) for n in lengths]
    return hashed.select(id, F.inline(F.concat(*runs)))


def item_runs(items: DataFrame) -> DataFrame:
    """``key, item_at, seed, length``: the runs by which items shorter than ``OVERLAP`` are found."""
    n = F.size("hashes")
    half = F.floor(n / 2).cast("int")
    part = lambda at, length: F.struct(at.alias("item_at"), length.alias("length"))
    whole = F.array(part(F.lit(0), n))
    halves = F.array(part(F.lit(0), half), part(half, n - half))
    runs = items.filter(n < OVERLAP).select(
        "key", "hashes", F.inline(F.when(n < SPAN, whole).otherwise(halves))
    )
    return runs.select("key", "item_at", _run(F.col("hashes"), F.col("item_at"), F.col("length")).alias("seed"), "length")


def most_alike(doc: Column, item: Column, at: Column) -> Column:
    """Most matches among ``OVERLAP`` tokens in a row, or all of a shorter item; 0 without such."""
    begin = F.greatest(-at, F.lit(0))
    length = F.least(F.size(item) - begin, F.size(doc) - (at + begin))
    x = F.slice(doc, at + begin + 1, length)
    y = F.slice(item, begin + 1, length)
    width = F.least(F.lit(OVERLAP), F.size(item))
    mask = F.call_function("shiftleft", F.lit(1), width) - 1
    start = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("seen"), F.lit(0).alias("most"))

    def step(done: Column, same: Column) -> Column:
        bits = (done["bits"] * 2 + F.when(same, 1).otherwise(0)).bitwiseAND(mask)
        seen = done["seen"] + 1
        most = F.when(seen >= width, F.greatest(done["most"], F.bit_count(bits))).otherwise(done["most"])
        return F.struct(bits.alias("bits"), seen.alias("seen"), most.alias("most"))

    return F.aggregate(F.zip_with(x, y, lambda a, b: a == b), start, step)["most"]


def overlap(doc: Column, item: Column, at: Column, least: int = LEAST) -> Column:
    """Best run of matches less substitutions, ``item`` laid over ``doc`` from ``at`` on."""
    begin = F.greatest(-at, F.lit(0))
    length = F.least(F.size(item) - begin, F.size(doc) - (at + begin))
    x = F.slice(doc, at + begin + 1, length)
    y = F.slice(item, begin + 1, length)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(done: Column, same: Column) -> Column:
        now = F.greatest(done["now"] + F.when(same, 1).otherwise(-PENALTY), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(done["best"], now).alias("best"))

    return F.aggregate(F.zip_with(x, y, lambda a, b: a == b), start, step)["best"]


def row_key(id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(id), F.col(text))


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = LEAST,
    whole: bool = False,
) -> DataFrame:
    """``row, doc, item, overlap`` of each document and item with a verified overlap."""
    items = land(
        benchmark.select(F.col(item_id).alias("item"), token_hashes(F.col(item_text)).alias("hashes"))
        .filter(F.size("hashes") >= (1 if whole else SPAN))
        .groupBy("hashes")
        .agg(F.min("item").alias("item"), F.count("*").alias("n")),
        "benchmark-items",
    ).select(F.xxhash64("hashes").alias("key"), "item", "hashes")
    table = seeds(items, "key")
    table = table.unpivot(["key", "at"], _SEEDS, "mask", "seed").select(
        "key", F.col("at").alias("item_at"), "seed"
    )
    lengths = []
    if whole:
        runs = land(item_runs(items), "benchmark-runs")
        lengths = sorted(r["length"] for r in runs.select("length").distinct().collect())
        table = table.unionByName(runs.select("key", "item_at", "seed"))
    table = land(table, "benchmark-seeds")
    bits = key_bitmap(table.select("seed"), SLOTS).scalar()
    texts = docs.select(
        row_key(id, text).alias("row"), F.col(id).alias("doc"), F.col(text).alias("body")
    )
    hashed = texts.select("row", token_hashes(F.col("body")).alias("hashes"))
    found = seeds(hashed, "row")
    maybe = lambda s: maybe_among(bits, s, SLOTS)
    found = found.filter(reduce(or_, (maybe(F.col(s)) for s in _SEEDS)))
    found = found.unpivot(["row", "at"], _SEEDS, "mask", "seed").select("row", "at", "seed")
    if lengths:
        found = found.unionByName(run_seeds(hashed, "row", lengths).filter(maybe(F.col("seed"))))
    laid = land(
        found.join(table, "seed")
        .select("row", "key", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct(),
        "seed-hits",
    )
    if whole:
        spread = (
            laid.join(items.filter(F.size("hashes") < SHORT).select("key"), "key")
            .groupBy("key")
            .agg(F.count_distinct("row").alias("n"))
        )
        ordinary = spread.filter(F.col("n") > max(FEW, RARE * docs.count())).select("key")
        laid = laid.join(land(ordinary, "ordinary-items"), "key", "left_anti")
    hit_docs = (
        texts.join(laid.select("row").distinct(), "row", "left_semi")
        .dropDuplicates(["row"])
        .select("row", "doc", token_hashes(F.col("body")).alias("doc_hashes"))
    )
    needed = F.least(F.lit(least), F.size("hashes"))
    n = F.size("hashes")
    allowed = F.when(n >= OVERLAP, 2).when(n >= SPAN, 1).otherwise(0)
    enough = F.col("overlap") >= F.col("needed")
    if whole:
        enough = enough | (F.col("alike") >= F.col("wanted"))
    return (
        laid.join(items, "key")
        .join(hit_docs, "row")
        .select(
            "row",
            "doc",
            "item",
            overlap(F.col("doc_hashes"), F.col("hashes"), F.col("shift")).alias("overlap"),
            needed.alias("needed"),
            most_alike(F.col("doc_hashes"), F.col("hashes"), F.col("shift")).alias("alike"),
            (F.least(F.lit(OVERLAP), n) - allowed).alias("wanted"),
        )
        .filter(enough)
        .groupBy("row", "doc", "item")
        .agg(F.max("overlap").alias("overlap"))
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``doc_id, contaminated, n_items, best_overlap`` for each row."""
    per_row = (
        contaminated_pairs(docs, benchmark, id, text, **options)
        .groupBy("row")
        .agg(F.count("*").alias("n_items"), F.max("overlap").alias("best_overlap"))
    )
    rows = docs.select(F.col(id).alias("doc"), row_key(id, text).alias("row"))
    return rows.join(per_row, "row", "left").select(
        F.col("doc").alias(id),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("best_overlap", F.lit(0)).alias("best_overlap"),
    )

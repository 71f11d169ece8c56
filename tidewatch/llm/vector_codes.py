"""Short codes for vectors: one codebook per part, trained by Lloyd rounds over active entries.

Components become integers, floor(scale * x), and a vector is cut into equal consecutive parts.
A part's codebook starts as that part of the vectors with the smallest ids.  A round assigns each
part to its nearest entry (squared distance, ties to the lower index) and moves each entry to the
floor of its parts' mean; entries without parts stay.  All arithmetic is on whole numbers, so the
result does not depend on how rows are dealt to tasks.

Every row keeps its parts' entries and exact distances.  In later rounds a part whose entry did
not move compares only the entries that did move against the distance it has stored: all others
are as far as before, and none of them was nearer.  Parts whose entry moved look at all entries.

Codebooks (parts x entries x width numbers) are all that reaches the driver, each task adds at most
one row per entry to their sums.  Rounds are landed tables.

Vectors that are null, or hold null or non-finite components, are left out.  Vectors of another
length than the first one that can be cut into the parts, and those with a component beyond
``LIMIT`` after scaling, stay with null code and errors and do not train.  Null ids come last.
Rows that share an id are rows of their own, smaller vectors first.  With fewer vectors than
entries the codebooks are so much shorter, without any they are empty.  Only the columns named
in ``carry`` are kept; they may be called anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import land

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: largest size of a scaled component
LIMIT = 1 << 24


@dataclass
class Codes:
    """``rows``: id, carried columns, code (a byte per part), part_errors, error."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """sha256 of all entries' components in order."""
        text = ",".join(map(str, self.books.ravel().tolist()))
        return hashlib.sha256(text.encode()).hexdigest()


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of ``x`` (n, width) to ``book`` (k, width)."""
    total = np.zeros((len(x), len(book)), np.int64)
    for position in range(x.shape[1]):
        total += (x[:, position, None] - book[None, :, position]) ** 2
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = distances(x, book)
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(x)), entry]


def assign(
    x: np.ndarray,
    book: np.ndarray,
    moved: np.ndarray | None = None,
    entry: np.ndarray | None = None,
    far: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries and distances of one part; also how many distances were computed.

    ``moved``: entries that changed since ``entry`` and ``far`` were found, None at first.
    """
    if moved is None:
        return *nearest(x, book), len(x) * len(book)
    entry, far = entry.copy(), far.copy()
    active = moved[entry]
    changed = np.flatnonzero(moved)
    fixed = np.flatnonzero(~active)
    if len(changed) and len(fixed):
        near, new = nearest(x[fixed], book[changed])
        near = changed[near]
        better = (new < far[fixed]) | ((new == far[fixed]) & (near < entry[fixed]))
        entry[fixed[better]], far[fixed[better]] = near[better], new[better]
    again = np.flatnonzero(active)
    if len(again):
        entry[again], far[again] = nearest(x[again], book)
    return entry, far, len(fixed) * len(changed) + len(again) * len(book)


def _cut(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with their entries and distances by these codebooks."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _cut(batch, parts)
            entry, far = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
            if moved is not None:
                held = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
                held = held.reshape(n, parts).astype(np.int64)
                known = batch.column("far").flatten().to_numpy().reshape(n, parts)
            for p in range(parts):
                before = () if moved is None else (moved[p], held[:, p], known[:, p])
                entry[:, p], far[:, p], _ = assign(x[:, p], books[p], *before)
            codes = [row.tobytes() for row in entry.astype(np.uint8)]
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("id", "carried", "v")),
                    pa.array(codes, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(far.ravel())),
                ],
                names=["id", "carried", "v", "code", "far"],
            )

    return rows.mapInArrow(run, rows.schema)


def _sums(assigned: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per part and entry the sum of the parts assigned to it, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cut(batch, parts)
            entry = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
            entry = entry.reshape(batch.num_rows, parts)
            for p in range(parts):
                np.add.at(total[p], entry[:, p], x[:, p])
                count[p] += np.bincount(entry[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(count[part, entry]),
                pa.ListArray.from_arrays(offsets, pa.array(total[part, entry].ravel())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    partial = assigned.select("v", "code").mapInArrow(
        run, "part int, entry int, n bigint, sums array<bigint>"
    )
    places = (F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect()
    total = np.zeros((parts, entries, width), np.int64)
    count = np.zeros((parts, entries), np.int64)
    for part, entry, n, *sums in merged:
        total[part, entry], count[part, entry] = sums, n
    return total, count


def compress_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    carry: Sequence[str] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes:
    """Train codebooks on all vectors and give each its code; see the module's text."""
    if not 1 <= entries <= 256:
        raise ValueError("entries are numbered in a byte: 1 to 256")
    x = F.col(vector).cast("array<double>")
    carried = F.struct(*(F.col(name) for name in carry)) if carry else F.struct(F.lit(0).alias("_"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    small = lambda e: F.abs(e) * scale < LIMIT
    kept = vectors.select(
        F.col(id).cast("bigint").alias("id"), carried.alias("carried"), x.alias("x")
    ).filter(F.col("x").isNotNull() & F.forall("x", finite))
    whole = F.transform("x", lambda e: F.floor(e * scale).cast("int"))
    rows = land(
        kept.select("id", "carried", F.when(F.forall("x", small), whole).alias("v")), "vectors"
    )
    fits = F.coalesce((F.size("v") > 0) & (F.size("v") % parts == 0), F.lit(False))
    first = F.col("id").asc_nulls_last()
    head = rows.filter(fits).orderBy(first, "v").select("v").first()
    length = len(head["v"]) if head else 0
    usable = F.coalesce(fits & (F.size("v") == length), F.lit(False))
    starts = rows.filter(usable).orderBy(first, "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in starts], np.int64).reshape(len(starts), parts, -1 if starts else 0)
    books = books.transpose(1, 0, 2).copy()
    state = rows.filter(usable).select(
        "*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<bigint>").alias("far")
    )
    if starts:
        moved = None
        for _ in range(rounds):
            state = land(_assigned(state, books, moved), "vector-round")
            total, count = _sums(state, *books.shape)
            means = total // np.maximum(count, 1)[:, :, None]
            after = np.where(count[:, :, None] > 0, means, books)
            moved, books = (after != books).any(axis=2), after
        state = land(_assigned(state, books, moved), "vector-codes")
    coded = state.select("id", "carried", "code", F.col("far").alias("part_errors"))
    others = rows.filter(~usable).select(
        "id",
        "carried",
        F.lit(None).cast("binary").alias("code"),
        F.lit(None).cast("array<bigint>").alias("part_errors"),
    )
    error = F.aggregate("part_errors", F.lit(0).cast("bigint"), lambda a, b: a + b)
    out = coded.unionByName(others).select(
        F.col("id").alias(id),
        *(F.col("carried")[name].alias(name) for name in carry),
        "code",
        "part_errors",
        error.alias("error"),
    )
    return Codes(out, books)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """Add the integer vector that a code stands for; null for a null code."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                None
                if c is None
                else books[np.arange(parts), np.frombuffer(c, np.uint8)].ravel().tolist()
                for c in batch.column(code).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.list_(pa.int64()))],
                names=[*batch.schema.names, out],
            )

    return codes.mapInArrow(
        run, codes.withColumn(out, F.lit(None).cast("array<bigint>")).schema
    )


def with_label_errors(rows: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Add ``label_error``: the errors summed over equal labels, nulls together.

    Sums are landed: few labels are then broadcast by their size, many are joined with hot labels
    split.
    """
    sums = land(
        rows.groupBy(F.col(label).alias("_label")).agg(F.sum(error).alias("label_error")),
        "label-errors",
    )
    return rows.join(sums, rows[label].eqNullSafe(sums["_label"]), "left").drop("_label")

"""Near-duplicate vectors by binary codes under a random rotation.

Each unit vector is rotated at random and kept as the signs of its coordinates, with the
inner product of vector and sign vector as correction factor.  Signs against another rotated
vector, divided by the factor, estimate the cosine without bias, and the error is bounded by
a multiple of sqrt((1 - f^2) / f^2 / (d - 1)).  Only pairs whose upper bound reaches the
threshold are computed again, in double precision; a link is decided by that alone.

Candidates share a value of signs under further random directions in one of several tables.
Bits per table grow with the logarithm of the number of vectors, tables are as many as find
a pair at the threshold with ``RECALL``.  Buckets are cut into blocks of at most about
``BLOCK`` vectors, and pairs of blocks are compared inside a task: pairs are counted and tied
together there and never become rows.  A pair met in several tables counts in the first.

Equal vectors are folded beforehand and unfolded in the result.  Vectors that are null, empty,
zero or hold null or non-finite components link with nothing; vectors of different length are
never linked.  Rows with a null id have no links, no component, and are kept.  Rows that share
an id and a vector are copies that link with each other.  Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import land
from tidewatch.llm.components import connected_components

COSINE = 0.9
RECALL = 0.995
BLOCK = 512
#: vectors that one task compares at a time
SHARD = 8192
#: the error bound in units of the estimate's scale
SIGMAS = 5.0


def plan_tables(count: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits per table and number of tables for so many vectors."""
    bits = min(32, max(6, math.ceil(math.log2(max(2, count))) - 4))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def directions(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(10_000 + dim).normal(size=(dim, bits * tables))


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and their correction factors."""
    rotated = units @ rotation(units.shape[1]).T
    signs = rotated >= 0
    return np.packbits(signs, axis=1), np.abs(rotated).sum(axis=1) / math.sqrt(units.shape[1])


def unpack(packed: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors along the signs."""
    return (np.unpackbits(packed, axis=1, count=dim) * 2.0 - 1.0) / math.sqrt(dim)


def bounds(factors: np.ndarray, dim: int) -> np.ndarray:
    f2 = np.minimum(factors**2, 1.0)
    return SIGMAS * np.sqrt((1 - f2) / f2 / max(1, dim - 1))


_CODED = "vector array<double>, rep bigint, copies bigint, code binary, factor double, values binary"


def encode(folded: DataFrame, bits: int, tables: int) -> DataFrame:
    """``folded``: vector, rep, copies. Add the code, its factor and the value in each table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                packed, factors = codes(units)
                signs = (units @ directions(dim, bits, tables)) >= 0
                weights = (1 << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
                values = (signs.reshape(-1, tables, bits) * weights).sum(axis=2).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(3)),
                        pa.array([row.tobytes() for row in packed], pa.binary()),
                        pa.array(factors),
                        pa.array([row.tobytes() for row in values], pa.binary()),
                    ],
                    names=["vector", "rep", "copies", "code", "factor", "values"],
                )

    return folded.mapInArrow(code, _CODED)


def _tie(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` vertices over the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(left: dict, right: dict | None, table: int, cosine: float):
    """Links between two blocks (or within one): positions, and their first table is this."""
    other = left if right is None else right
    dim = left["unit"].shape[1]
    rotated = other["unit"] @ rotation(dim).T
    estimate = unpack(left["code"], dim) @ rotated.T / left["factor"][:, None]
    likely = estimate + bounds(left["factor"], dim)[:, None] >= cosine
    if right is None:
        likely |= likely.T
        likely = np.triu(likely, 1)
    a, b = np.nonzero(likely)
    exact = np.empty(len(a))
    for start in range(0, len(a), 100_000):
        part = slice(start, start + 100_000)
        exact[part] = np.einsum("ij,ij->i", left["unit"][a[part]], other["unit"][b[part]])
    close = exact >= cosine
    a, b = a[close], b[close]
    if table:
        seen = np.zeros(len(a), bool)
        for t in range(table):
            seen |= left["values"][a, t] == other["values"][b, t]
        return a[~seen], b[~seen]
    return a, b


def _links(bits: int, tables: int, cosine: float):
    def links(shard: pa.Table) -> pa.Table:
        block = shard.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        out = ([], [], [])
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            part = shard.take(pa.array(rows))
            sides = part.column("side").to_numpy()
            ids = part.column("rep").to_numpy()
            copies = part.column("copies").to_numpy()
            vectors = part.column("vector").combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            x = vectors.flatten().to_numpy().reshape(len(rows), sizes[0])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            full = {
                "unit": x / np.linalg.norm(x, axis=1, keepdims=True),
                "code": _bytes(part.column("code"), np.uint8),
                "factor": part.column("factor").to_numpy(),
                "values": _bytes(part.column("values"), np.uint32),
            }
            table = int(part.column("table")[0].as_py())
            if sides[0] == 2:
                at, bt = compare(full, None, table, cosine)
                a, b = at, bt
            else:
                left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
                if not len(left) or not len(right):
                    continue
                pick = lambda where: {k: v[where] for k, v in full.items()}
                at, bt = compare(pick(left), pick(right), table, cosine)
                a, b = left[at], right[bt]
            if not len(a):
                continue
            count = np.zeros(len(rows), np.int64)
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            by_id = np.sort(ids, kind="stable")
            root = by_id[_tie(len(rows), rank[a], rank[b])][rank]
            linked = np.flatnonzero(count)
            for column, values in zip(out, (ids[linked], count[linked], root[linked])):
                column.append(values)
        none = [np.zeros(0, np.int64)]
        return pa.table(
            {k: np.concatenate(v or none) for k, v in zip(("rep", "n_links", "root"), out)}
        )

    return links


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in column.to_pylist()])


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    rows = vectors.select(
        F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = (
        F.col("id").isNotNull()
        & (F.coalesce(F.size("vector"), F.lit(0)) > 0)
        & F.forall("vector", finite)
        & F.exists("vector", lambda v: v != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    folded = rows.filter(usable).groupBy("vector").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")
    )
    folded = land(folded, "folded-vectors")
    bits, tables = plan_tables(folded.count(), cosine)
    coded = land(encode(folded, bits, tables), "vector-codes")
    linked = land(_linked(coded, bits, tables, cosine), "vector-links")
    parts = connected_components(linked, "rep", "root")
    sums = linked.groupBy("rep").agg(F.sum("n_links").alias("n"))
    of_rep = (
        folded.join(sums, "rep", "left")
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "vector",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    found = rows.filter(usable).join(of_rep, "vector").select("id", "n_links", "component_id")
    alone = rows.filter(~usable).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return found.unionByName(alone).select(
        F.col("id").alias(id),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _linked(coded: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """``rep, n_links, root`` of each block that holds a link of the vector."""
    value = lambda t: F.substring("values", t * 4 + 1, F.lit(4))
    table = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")
    placed = coded.select("rep", table, "values", F.size("vector").alias("dim")).select(
        "rep", "table", F.xxhash64("dim", "table", value(F.col("table"))).alias("bucket")
    )
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    spread = (
        placed.join(sizes, "bucket")
        .select("rep", "table", "bucket", own.alias("own"), other)
        .select(
            "rep",
            "table",
            F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
            F.when(F.col("own") == F.col("other"), 2)
            .when(F.col("own") < F.col("other"), 0)
            .otherwise(1)
            .alias("side"),
        )
    )
    spread = land(spread, "vector-blocks")
    shards = max(1, spread.count() // SHARD)
    whole = spread.join(coded, "rep").withColumn("shard", F.pmod("block", F.lit(shards)))
    return whole.groupBy("shard").applyInArrow(
        _links(bits, tables, cosine), "rep bigint, n_links bigint, root bigint"
    )

"""Shards of nearly equal bytes: a minimax partition of ordered, atomic groups.

Rows with equal text are a group and never parted.  Groups lie in one order: larger groups (in
bytes, all copies together) first, of these the ones with fewer copies, then by the text's hash.
The order is cut into contiguous shards.  The capacity of a cut is found by binary search: the
smallest one at which filling shards greedily, one after the other, places all groups.  The first
shard is then cut there, and what is left is cut in the same way into one shard less, so that a
group larger than its share costs only its own shard and the others stay even.  No partition of
this order has a smaller largest shard.

Groups that are alike in bytes and copies are next to each other in the order, so the search
needs only how many there are of each kind.  This table of kinds is what reaches the driver: the
kinds' bytes add up to no more than the input's T bytes, which bounds them by about
sqrt(2 T ln T) whatever the number of rows; texts differ less than that.  Everything of the
size of the table is sorted, numbered by range partitions, and cut at the row numbers the search
gave; copies of one text are spread over as many partitions as they need.

A null text counts as empty.  Rows are numbered within a shard from 0 in the order above, then by
id (nulls first); repeated rows follow each other.  An empty table gives an empty result, fewer
groups than shards leave shards empty.  Other columns come along only if named in ``carry``; a
name that clashes with an output is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import land

SHARDS = 8
OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


class Kinds:
    """Runs of equal groups in their order: ``size`` bytes and ``rows`` each, ``count`` of them."""

    def __init__(self, size: np.ndarray, rows: np.ndarray, count: np.ndarray):
        size, rows, count = (np.asarray(x, np.int64) for x in (size, rows, count))
        order = np.lexsort((rows, -size))
        self.size, self.rows, self.count = size[order], rows[order], count[order]
        self.bytes_to = np.cumsum(self.size * self.count)
        self.groups_to = np.cumsum(self.count)
        self.rows_to = np.cumsum(self.rows * self.count)

    @property
    def groups(self) -> int:
        return int(self.groups_to[-1]) if len(self.size) else 0

    def before(self, group: int, of: str) -> int:
        """Bytes or rows of the first ``group`` groups."""
        kind = int(np.searchsorted(self.groups_to, group, "right"))
        total, each = (self.bytes_to, self.size) if of == "bytes" else (self.rows_to, self.rows)
        done = int(total[kind - 1]) if kind else 0
        left = group - (int(self.groups_to[kind - 1]) if kind else 0)
        return done + (left * int(each[kind]) if left else 0)

    def fill(self, start: int, capacity: int) -> int:
        """End of the longest run of groups from ``start`` that fits."""
        limit = self.before(start, "bytes") + capacity
        kind = int(np.searchsorted(self.bytes_to, limit, "right"))
        if kind == len(self.size):
            return self.groups
        done = int(self.bytes_to[kind - 1]) if kind else 0
        first = int(self.groups_to[kind - 1]) if kind else 0
        return first + (limit - done) // int(self.size[kind])

    def fits(self, start: int, shards: int, capacity: int) -> bool:
        for _ in range(shards):
            start = self.fill(start, capacity)
        return start >= self.groups

    def smallest_capacity(self, start: int, shards: int) -> int:
        """By binary search between the even share, or the largest group, and all."""
        rest = self.before(self.groups, "bytes") - self.before(start, "bytes")
        kind = int(np.searchsorted(self.groups_to, start, "right"))
        low, high = max(-(-rest // shards), int(self.size[kind])), rest
        while low < high:
            middle = (low + high) // 2
            if self.fits(start, shards, middle):
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, shards: int) -> list[int]:
        """First group of each shard, and the number of groups."""
        found = [0]
        for left in range(shards, 0, -1):
            start = found[-1]
            if start >= self.groups:
                found.append(start)
                continue
            found.append(self.fill(start, self.smallest_capacity(start, left)))
        return found


def _numbered(frame: DataFrame, *order) -> DataFrame:
    """Add ``row``, dense from 0 in this order, without a window over all rows.

    Rows are range partitioned, landed with their place, and shifted by the partitions before.
    """
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = frame.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = land(placed.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("row", F.col("_start") + inside)
        .drop("_at", "_part", "_start")
    )


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    id: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` of each row, and ``carry``."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    if clash := {id, *carry} & {*OUTPUT, "_key"}:
        raise ValueError(f"these names are taken: {sorted(clash)}")
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id).cast("bigint").alias("_id"),
        (F.octet_length(utf8) + 1).cast("bigint").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.unhex(F.sha2(utf8, 256)).alias("_key"),
        F.monotonically_increasing_id().alias("_nth"),
        F.struct(*(F.col(c) for c in carry)).alias("_carried") if carry else F.lit(0).alias("_carried"),
    )
    rows = land(rows, "texts")
    groups = land(
        rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_copies")), "groups"
    )
    kinds = groups.groupBy("_bytes", "_copies").agg(F.count("*").alias("n")).toPandas()
    kinds = Kinds(kinds["_bytes"].to_numpy(), kinds["_copies"].to_numpy(), kinds["n"].to_numpy())
    starts = [kinds.before(cut, "rows") for cut in kinds.cuts(shards)]
    ordered = _numbered(
        rows.join(groups, "_key"),
        F.desc("_bytes"), "_copies", "_key", "_id", "_nth",
    )
    shard, first = F.lit(0), F.lit(starts[0])
    for k in range(1, shards):
        if starts[k] < starts[-1]:
            later = F.col("row") >= starts[k]
            shard, first = F.when(later, k).otherwise(shard), F.when(later, starts[k]).otherwise(first)
    return ordered.select(
        F.col("_id").alias(id),
        *(F.col("_carried")[c].alias(c) for c in carry),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("row") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within its files; files are cut by slots."""
    n = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    laid.write.partitionBy("shard").parquet(path)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

MASK64 = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def land(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` below the shared folder and read it back: cuts the lineage."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def land_and_release(frame: DataFrame, label: str) -> DataFrame:
    """``land``, after which Spark removes the shuffle files it took: the table is written, and no
    later read needs them."""
    spark, key = frame.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return land(frame, label)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the system: workers are kept between tasks, and what one task's
    tables took would otherwise stay theirs during the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(slots))


def _bit(key: Column) -> Column:
    return key.bitwiseAND(63).cast("int")


def key_bitmap(keys: DataFrame, slots: int) -> DataFrame:
    """One row ``bitmap``: ``slots`` words of 64 bits, a bit set for each of the hashes in the
    only column of ``keys``.  The size is fixed; many keys make it say yes more often."""
    key = F.col(keys.columns[0])
    one = F.lit(1).cast("bigint")
    words = keys.groupBy(_slot(key, slots).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", one, _bit(key))).alias("word")
    )
    filled = keys.sparkSession.range(slots).join(words, F.col("id") == F.col("slot"), "left")
    entry = F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return filled.agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["word"]).alias("bitmap")
    )


def maybe_among(bitmap: Column, key: Column, slots: int) -> Column:
    """False only for hashes that are not in the bitmap."""
    word = F.get(bitmap, _slot(key, slots).cast("int"))
    return F.call_function("getbit", word, _bit(key)) == 1


def row_tie(docs: DataFrame, id: str, text: str, slots: int = 1 << 18) -> Column:
    """With the id it tells rows of different texts apart: a hash of both for ids that occur again,
    0 for those a bitmap of fixed size knows to occur once, which compresses to nothing."""
    again = docs.groupBy(id).agg(F.count("*").alias("n")).filter("n > 1")
    key = F.xxhash64(id)
    several = maybe_among(key_bitmap(again.select(key), slots).scalar(), key, slots)
    return F.when(several, F.xxhash64(id, text)).otherwise(F.lit(0).cast("bigint"))


class WordHashes(dict):
    """64-bit hashes of byte words, remembered; the memory it takes is bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbours; fewer neighbours give none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = 0x9E3779B97F4A7C15 | 1
    done, total, power, block = 0, np.zeros(n, np.uint64), 1, hashes
    size, step = 1, factor
    rest = width
    while rest:
        if rest & 1:
            total += block[done : done + n] * np.uint64(power)
            done += size
            power = power * step & MASK64
        rest >>= 1
        if rest:
            block = block[: len(block) - size] + block[size:] * np.uint64(step)
            size, step = size * 2, step * step & MASK64
    return mix(total)

"""Ordered computations over series of any length.

A plain window puts a whole series in one task, which fails when one series holds a
large share of all rows.  Here a series is cut into slices along its order; the window
runs within a slice, and a table with one row per (series, slice) carries what a slice
needs from the slices before it.

The row before (``with_previous``) is such a scan: rows are read and shuffled once, by (series,
slice), and landed with what they found in their slice.  Only the last row of each slice takes
part in the second step, and only the first row of each gets what it carries; all others are done.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import land

_KEY, _SLICE = "_series", "_slice"

#: hash buckets in which rows are counted by key, and rows of a bucket that one task may hold
BUCKETS = 1 << 16
CROWD = 200_000
#: rows a task is dealt where many are sorted or gathered
DEALT = 250_000


def dealt(df: DataFrame, rows: int, keys: Sequence[str], per_task: int = DEALT) -> DataFrame:
    """``df`` of about ``rows`` rows, dealt by ``keys`` so that a task gets about ``per_task`` of them.

    How many rows fit a number of shuffled bytes depends on how well they compress; tasks sized by
    bytes alone may hold too many to sort in memory.  Small tables stay as they are.
    """
    tasks = ceil(rows / per_task)
    if tasks < 4:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, least), *keys)


def time_slice(at: str, seconds: int) -> Column:
    """Number of the ``seconds``-wide slice holding a timestamp."""
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000))


def _keyed(df: DataFrame, keys: Sequence[str], slice_: Column) -> DataFrame:
    # A struct key is never null and compares null parts as equal, unlike plain columns.
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys).alias(_KEY), slice_.alias(_SLICE), *rest)


def _restored(df: DataFrame, columns: Sequence[str], keys: Sequence[str], added: dict) -> DataFrame:
    back = [F.col(f"{_KEY}.{c}").alias(c) if c in keys else F.col(c) for c in columns]
    return df.select(*back, *(column.alias(name) for name, column in added.items()))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    slice_seconds: int = 3600,
    prefix: str = "previous_",
) -> DataFrame:
    """Add ``at`` and ``values`` of the row before, per series; null on a series' first row.

    Within a series ``at`` is expected to be unique (see ``tsds_dedup``).
    """
    shown = (at, *values)
    sliced = land(in_slices(df, keys, at, shown, slice_seconds), "slices")
    ends = sliced.filter("_ends").select(_KEY, _SLICE, F.struct(*shown).alias("_end"))
    across = Window.partitionBy(_KEY).orderBy(_SLICE)
    carried = ends.select(_KEY, _SLICE, F.lag("_end").over(across).alias("_carry"))
    heads = sliced.filter("_starts").drop("_before").join(carried, [_KEY, _SLICE], "left")
    rows = sliced.filter("NOT _starts").unionByName(heads.withColumnRenamed("_carry", "_before"))
    added = {f"{prefix}{c}": F.col(f"_before.{c}") for c in shown}
    return _restored(rows, df.columns, keys, added)


def in_slices(
    df: DataFrame, keys: Sequence[str], at: str, shown: Sequence[str], slice_seconds: int
) -> DataFrame:
    """Rows with ``_before``, the ``shown`` columns of the row before in the series' slice, and
    whether they are the first (``_starts``) or last (``_ends``) of it: one read, one shuffle."""
    rows = _keyed(df, keys, time_slice(at, slice_seconds))
    inside = Window.partitionBy(_KEY, _SLICE).orderBy(at)
    return rows.withColumns(
        {
            "_before": F.lag(F.struct(*shown)).over(inside),
            "_starts": F.lag(F.lit(True)).over(inside).isNull(),
            "_ends": F.lead(F.lit(True)).over(inside).isNull(),
        }
    )


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, per series in ``at`` order."""
    rows = _keyed(df, keys, time_slice(at, slice_seconds))
    inside = (
        Window.partitionBy(_KEY, _SLICE)
        .orderBy(at)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_inside", F.sum(value).over(inside))
    totals = (
        _keyed(df.select(*dict.fromkeys([*keys, at, value])), keys, time_slice(at, slice_seconds))
        .groupBy(_KEY, _SLICE)
        .agg(F.sum(value).alias("_total"))
    )
    earlier = (
        Window.partitionBy(_KEY).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(_KEY, _SLICE, F.sum("_total").over(earlier).alias("_carry"))
    joined = rows.join(totals, [_KEY, _SLICE], "left")
    return _restored(
        joined, df.columns, keys, {out: F.col("_inside") + F.coalesce("_carry", F.lit(0))}
    )


def with_row_number_sliced(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[str],
    order: Sequence[str],
    out: str,
    crowd: int = CROWD,
) -> DataFrame:
    """Number rows 1, 2, … per key in the order (``slices``, ``order``).

    Rows are shuffled once, by key, to as many tasks as their number asks for.  Only keys that may hold more than ``crowd`` rows are cut: each
    of their (key, slice) is numbered on its own and shifted by the sizes of the slices before it, so
    a key holding a large share of the rows is spread over many tasks.  Rows without a key or with
    a null in ``slices`` are left out; the latter take numbers.
    """
    df = df.filter(_all_there(keys))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    # Keys are counted by hash bucket: a small table, of which fewer than a quarter can be crowded.
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_total", F.sum("_size").over(Window.partitionBy()))
    over = F.when(F.col("_size") > crowd + 4 * (F.col("_total") / BUCKETS), F.col("_bucket"))
    total, crowded = sizes.agg(F.max("_total"), F.collect_list(over)).first()
    whole = df.filter(~bucket.isin(crowded)) if crowded else df
    numbered = _numbered(dealt(whole, total or 0, keys), keys, slices, order, out)
    if not crowded:
        return numbered
    cut = _numbered_in_slices(df.filter(bucket.isin(crowded)), keys, slices, order, out)
    return numbered.unionByName(cut)


def _numbered(
    df: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    whole = Window.partitionBy(*keys).orderBy(*slices, *order)
    return df.withColumn(out, F.row_number().over(whole)).filter(_all_there(slices))


def _all_there(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(c).isNotNull() for c in columns), F.lit(True))


def _numbered_in_slices(
    df: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    inside = Window.partitionBy(*keys, *slices).orderBy(*order)
    rows = df.withColumn("_inside", F.row_number().over(inside))
    earlier = (
        Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        df.groupBy(*keys, *slices)
        .agg(F.count("*").alias("_size"))
        .withColumn("_carry", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    return (
        rows.join(sizes, [*keys, *slices])
        .withColumn(out, F.col("_inside") + F.col("_carry"))
        .drop("_inside", "_carry")
    )

"""Connected components of a link table, by alternating star contractions.

Each round points every vertex at its smallest neighbour, first from the larger side and then
from the smaller, until nothing changes; rounds grow with the logarithm of the longest path.
Minima are folded before the shuffle and joined back as a table, so the centre of a star is no
single task's work.  Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.llm.common import land


def _large_star(links: DataFrame) -> DataFrame:
    """``links``: (a, b) with a > b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy(F.col("u").alias("b")).agg(F.min("v").alias("m")).filter("m < b")
    # Landed, so that both sides of the join are exchanges: a centre of a star is split.
    return links.join(land(least, "least"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return (
        joined.select("a", F.col("m").alias("b"))
        .unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        .distinct()
    )


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links landed, and their number and a sum over them, observed while writing."""
    seen = Observation()
    links = land(
        links.observe(
            seen,
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ),
        "links",
    )
    return links, (seen.get["n"], seen.get["sum"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for each id that has a link; the component is its smallest id.

    Nulls and links of an id to itself are left out.  No links give no rows.
    """
    links, before = _written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .filter("a <> b")
        .distinct()
    )
    while True:
        links, after = _written(_small_star(_large_star(links)))
        if after == before:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = after

"""The audit of page chains on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.durations import spark_interval


def stream_chain_audit(
    pages: DataFrame, at: str = "fetched_at", within: str = "1h", late: str = "10m"
) -> DataFrame:
    """Pages that others name as next and that do not land ``within`` the bound of it.

    Tokens named are joined with pages landed, both with a watermark ``late`` behind the newest
    page, so what either side remembers is bounded.  A token is reported once its bound has passed
    for good, and once only; a page that lands in time, before or after it is named, is not.
    """
    # The watermark comes first: last pages, which name none, move it for both sides.
    pages = pages.withWatermark(at, spark_interval(late))
    named = (
        pages.filter("next_page_token <> '' AND next_page_token IS NOT NULL")
        .select(
            F.col("next_page_token").alias("missing_token"),
            F.col("page_token").alias("named_by"),
            F.col(at).alias("named_at"),
        )
        .dropDuplicatesWithinWatermark(["missing_token"])
    )
    landed = pages.select(F.col("page_token").alias("_token"), F.col(at).alias("_landed_at"))
    bound = F.expr(f"INTERVAL {spark_interval(within)}")
    found = (
        (F.col("missing_token") == F.col("_token"))
        & (F.col("_landed_at") >= F.col("named_at") - bound)
        & (F.col("_landed_at") <= F.col("named_at") + bound)
    )
    return (
        named.join(landed, found, "leftOuter")
        .filter("_token IS NULL")
        .select("missing_token", "named_by", "named_at")
    )

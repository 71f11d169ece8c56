"""Landed job-run API pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.durations import cutoff_ms
from tidewatch.schema.fixed_values import LOOKBACK
from tidewatch.schema.source_types import CORRUPT, RUN_PAGE


def read_run_pages(spark: SparkSession, path: str, pretty_printed: bool = False) -> DataFrame:
    """Response pages as rows; one page per line keeps files splittable.

    A page that cannot be read in full stays, with its text in ``_corrupt_record``.
    """
    reader = spark.read.schema(f"{RUN_PAGE}, {CORRUPT} string")
    return reader.json(path, multiLine=pretty_printed, columnNameOfCorruptRecord=CORRUPT)


def stream_run_pages(
    spark: SparkSession, path: str, schema: str = RUN_PAGE, files_per_trigger: int | None = None
) -> DataFrame:
    """Pages as they land; those that cannot be read in full as in ``read_run_pages``."""
    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string")
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def lookback_filter(
    df: DataFrame,
    now: datetime | Column,
    lookback: str = LOOKBACK,
    start: str | Column = "start_time",
) -> DataFrame:
    """Runs that started within ``lookback`` of ``now`` (epoch-ms column).

    ``now`` may be a column, such as the time a page was fetched.  Rows with a
    ``decode_error`` stay.
    """
    start = F.col(start) if isinstance(start, str) else start
    recent = start >= F.lit(cutoff_ms(now, lookback))
    if "decode_error" in df.columns:
        recent |= F.col("decode_error").isNotNull()
    return df.filter(recent)


def page_chain_audit(pages: DataFrame) -> DataFrame:
    """Tokens that were handed out but whose page never landed, with the pages naming them.

    Both sides shrink to one row per token before they meet, so a token repeated by many
    pages costs no more than any other.
    """
    wanted = (
        pages.filter(F.coalesce("next_page_token", F.lit("")) != "")
        .groupBy(F.col("next_page_token").alias("missing_token"))
        .agg(F.count("*").alias("n_pages"), F.min("page_token").alias("first_page_token"))
    )
    landed = pages.select(F.col("page_token").alias("missing_token")).distinct()
    return wanted.join(landed, "missing_token", "left_anti")


def require_complete_chain(pages: DataFrame) -> DataFrame:
    """``pages`` unchanged; raises when a page of the chain is missing."""
    missing = page_chain_audit(pages).select("missing_token").take(1)
    if missing:
        raise ValueError(f"page with token {missing[0].missing_token!r} never landed")
    return pages

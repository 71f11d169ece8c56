"""Rows stored per data stream: ``<type>-<dataset>-<namespace>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.streaming.runs import run_batches

PARTITIONS = ("data_stream_type", "data_stream_dataset", "data_stream_namespace")
BATCH = "batch"


def stream_name() -> Column:
    return F.concat_ws("-", *PARTITIONS)


def to_stream(
    df: DataFrame, type: str, dataset: str | Column, namespace: str = "default"
) -> DataFrame:
    """Add the three columns that say where a row is stored."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    values = (F.lit(type), dataset, F.lit(namespace))
    return df.select(*df.columns, *(v.alias(n) for n, v in zip(PARTITIONS, values)))


def write_stream_tables(
    df: DataFrame, root: str, mode: str = "append", order: Sequence[str] = ()
) -> None:
    """Store rows as Parquet, one folder per data stream.

    The rebalance hint gathers a stream's rows into files of a sensible size, merging
    small streams' partitions and splitting those of a stream that holds much of the
    data.  ``order`` (dimensions, then time) sorts within the files.
    """
    laid_out = df.hint("rebalance", *PARTITIONS)
    if order:
        laid_out = laid_out.sortWithinPartitions(*PARTITIONS, *order)
    laid_out.write.partitionBy(*PARTITIONS).mode(mode).parquet(root)


def route_batch(rows: DataFrame, root: str, batch: int, order: Sequence[str] = ()) -> None:
    """Store a numbered batch, all its streams in one write, each in the stream's folder.

    The batch's own folders are replaced, those of other batches stay, so a batch that comes
    again after a failure leaves the tables as if it had come once.
    """
    numbered = rows.withColumn(BATCH, F.lit(batch))
    laid_out = numbered.hint("rebalance", *PARTITIONS)
    if order:
        laid_out = laid_out.sortWithinPartitions(*PARTITIONS, *order)
    (
        laid_out.write.partitionBy(*PARTITIONS, BATCH)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(root)
    )


def route_stream(df: DataFrame, root: str, checkpoint: str, order: Sequence[str] = ()) -> None:
    """Route what has landed of a stream, batch by batch."""
    run_batches(df, lambda rows, batch: route_batch(rows, root, batch, order), checkpoint)


def read_stream_tables(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def stream_table_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(stream_name().alias("stream_name")).agg(F.count("*").alias("n_rows"))

"""Driver and executor log files as ordered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema.fixed_values import DRIVER_LOG_FILES, EXECUTOR_LOG_FILES, LOG_DATASETS

_FILES = {"driver": DRIVER_LOG_FILES, "executor": EXECUTOR_LOG_FILES}
_FOLDERS = {"driver": "driver/logs", "executor": "spark/work/*/*"}


def _name_filter(files: Sequence[str]) -> str:
    return "{" + ",".join(files) + "}"


def exclude_gz(df: DataFrame, path: str | Column = "_metadata.file_path") -> DataFrame:
    """Leave out compressed rotations (on the metadata column the files are not opened)."""
    path = F.col(path) if isinstance(path, str) else path
    return df.filter(~path.endswith(".gz"))


def _as_lines(text: DataFrame) -> DataFrame:
    """Lines with file, block and a position that grows within each block.

    One task reads a block front to back, so the id taken right after the scan orders it.
    """
    return exclude_gz(text).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def read_logs(
    spark: SparkSession, root: str, kind: str, files: Sequence[str] | None = None
) -> DataFrame:
    """Log lines of ``kind`` (``driver`` or ``executor``) below ``root``.

    ``files`` replaces the usual names, for logs landed under other ones.
    """
    text = spark.read.option("pathGlobFilter", _name_filter(files or _FILES[kind])).text(
        f"{root.rstrip('/')}/{_FOLDERS[kind]}"
    )
    return _as_lines(text)


def stream_logs(
    spark: SparkSession, root: str, kind: str, files: Sequence[str] | None = None
) -> DataFrame:
    text = spark.readStream.option("pathGlobFilter", _name_filter(files or _FILES[kind])).text(
        f"{root.rstrip('/')}/{_FOLDERS[kind]}"
    )
    return _as_lines(text)


def log_route(df: DataFrame, path: str = "file") -> DataFrame:
    """Add the dataset a log file belongs to; null for a path that is neither kind."""
    return df.withColumn(
        "dataset",
        F.when(F.col(path).rlike("/driver/logs/[^/]*$"), LOG_DATASETS["driver"]).when(
            F.col(path).rlike("/spark/work/[^/]+/[^/]+/[^/]*$"), LOG_DATASETS["executor"]
        ),
    )

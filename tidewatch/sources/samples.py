"""Landed JMX samples and node system metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema.source_types import JMX_SAMPLE, SYSTEM_METRIC


def read_jmx_samples(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(JMX_SAMPLE).format(format).load(path)


def stream_jmx_samples(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(JMX_SAMPLE).format(format).load(path)


def with_system_dataset(df: DataFrame) -> DataFrame:
    """Add ``system.<metricset>`` as the row's dataset."""
    return df.withColumn("dataset", F.concat(F.lit("system."), "metricset"))


def read_system_metrics(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return with_system_dataset(spark.read.schema(SYSTEM_METRIC).format(format).load(path))

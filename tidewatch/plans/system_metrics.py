"""System metrics of nodes as stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.nodes import add_node_facts
from tidewatch.sinks.stream_tables import to_stream
from tidewatch.sources.samples import with_system_dataset

SYSTEM_NAMESPACE = "databricks"


def stored_system_metrics(
    metrics: DataFrame, nodes: DataFrame, namespace: str = SYSTEM_NAMESPACE
) -> DataFrame:
    """Rows of every metric set with role and facts of their node, and the set's data stream.

    An inventory with ``seen_at`` gives each row the facts its node had at sampling time.
    """
    rows = metrics if "dataset" in metrics.columns else with_system_dataset(metrics)
    at = "ts" if "seen_at" in nodes.columns else None
    rows = add_node_facts(rows.drop("metricset"), nodes, at=at)
    return to_stream(rows, "metrics", F.col("dataset"), namespace).drop("dataset")

"""Metric event tables, one per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import metrics as steps
from tidewatch.operators.nodes import add_node_facts
from tidewatch.schema.fixed_values import DATASET_PREFIX, NODE_FACTS
from tidewatch.sinks.stream_tables import to_stream

_PARSERS = {
    "driver": steps.parse_driver_name,
    "executor": steps.parse_executor_name,
    "application": steps.parse_application_name,
}


def metric_events(samples: DataFrame, stream: str) -> DataFrame:
    """Events of one stream: typed values, names, constants and error rows.

    No shuffle: the name patterns are joined by broadcast, all else is row by row.
    """
    matched = steps.match_catalogue(samples, [stream]).drop("stream", "kind")
    events = (
        steps.as_payload(matched)
        .transform(steps.to_namespace, stream)
        .transform(steps.metric_constants)
    )
    if stream in _PARSERS:
        events = _PARSERS[stream](events)
        events = steps.metric_error(steps.store_identity(events, stream))
    else:
        events = events.withColumn("error_message", F.lit(None).cast("string"))
    return steps.drop_payload(events).drop("identity")


def node_metrics(samples: DataFrame, every: str | None = None) -> DataFrame:
    """Node metrics folded to one row per host and sample time (or bucket)."""
    return steps.node_row(steps.match_catalogue(samples, ["node"]), every)


def wide_table(samples: DataFrame, stream: str) -> DataFrame:
    """Metric events of one stream as plain typed columns."""
    return steps.wide_metrics(
        metric_events(samples, stream), stream, keep=("ts", "host", "error_message")
    )


def stored_metrics(samples: DataFrame, stream: str, nodes: DataFrame) -> DataFrame:
    """The stream's table as stored: one row per series and time, node facts, data stream.

    Samples that arrive several times are folded first, by their full dimensions, so the
    wide rows need no other shuffle for it.  An inventory with ``seen_at`` gives each row the
    facts its node had at sampling time.
    """
    once = steps.tsds_dedup(samples)
    facts = ("node_role", *NODE_FACTS)
    at = "ts" if "seen_at" in nodes.columns else None
    rows = add_node_facts(wide_table(once, stream), nodes, at=at)
    others = [c for c in rows.columns if c not in facts]
    return to_stream(rows.select(*others, *facts), "metrics", f"{DATASET_PREFIX}{stream}")

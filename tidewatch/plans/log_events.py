"""The log event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.log_events import multiline
from tidewatch.operators.nodes import add_node_facts
from tidewatch.sinks.stream_tables import to_stream
from tidewatch.sources.logs import log_route

LOG_TYPE = "logs"
LOG_NAMESPACE = "databricks"


def log_event_table(
    lines: DataFrame,
    nodes: DataFrame,
    host: str | Column = "host",
    path: str | Column = "file",
    max_lines: int | None = None,
    namespace: str = LOG_NAMESPACE,
) -> DataFrame:
    """Lines of driver and executor logs as stored: events with node facts and data stream.

    ``host`` and ``path`` are told by the file of an event.  Files that are neither kind of
    log are left out.
    """
    return stored_log_events(multiline(lines, max_lines=max_lines), nodes, host, path, namespace)


def stored_log_events(
    events: DataFrame,
    nodes: DataFrame,
    host: str | Column = "host",
    path: str | Column = "file",
    namespace: str = LOG_NAMESPACE,
) -> DataFrame:
    """The same of events that are made already, such as a batch of a stream's (``LogEventFeed``,
    ``multiline_stream``), ready to be routed (``route_batch``)."""
    host = F.col(host) if isinstance(host, str) else host
    path = F.col(path) if isinstance(path, str) else path
    events = events.withColumns({"host": host, "path": path})
    routed = log_route(events, "path").filter(F.col("dataset").isNotNull())
    facts = add_node_facts(routed, nodes)
    return to_stream(facts, LOG_TYPE, F.col("dataset"), namespace).drop("dataset")

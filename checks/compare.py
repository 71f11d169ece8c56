"""Compare a query with its SQL counterpart: columns, row count and values."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cells(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NA or value != value:
            return ""
        if isinstance(value, bool):
            return str(value)
        try:
            return repr(float(value)) if not isinstance(value, str) else value
        except (TypeError, ValueError):
            return str(value)

    columns = [[cell(v) for v in frame[name].astype(object)] for name in sorted(frame.columns)]
    return sorted(zip(*columns))


def difference(spark: SparkSession, sf_dir: str, run, sql: str) -> str | None:
    """What differs, or None when query and SQL agree."""
    found = run(spark, sf_dir).toPandas()
    wanted = connect(sf_dir).execute(sql).fetch_df()
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} vs {sorted(wanted.columns)}"
    if len(found) != len(wanted):
        return f"rows {len(found)} vs {len(wanted)}"
    for mine, theirs in zip(_cells(found), _cells(wanted)):
        if mine != theirs:
            return f"row {mine} vs {theirs}"
    return None

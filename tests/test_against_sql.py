"""Every query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from checks import inputs, oracle, queries
from checks.compare import difference

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()
SQL = oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    assert difference(spark, SF, QUERIES[key], SQL[key]) is None


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("key", ["split_tasks_keep_parent", "dedup_terminated", "job_events"])
def test_runs_listed_in_parts_give_the_same_result(spark, key, monkeypatch):
    """Tasks are listed 2 at a time."""
    cached = (inputs.listed_runs, inputs.runs, inputs.run_pages, inputs.polled_pages)
    cached += (inputs.task_rows,)
    for function in cached:
        function.cache_clear()
    monkeypatch.setattr(inputs, "TASKS_LISTED", 2)
    try:
        assert difference(spark, SF, QUERIES[key], SQL[key]) is None
    finally:
        for function in cached:
            function.cache_clear()

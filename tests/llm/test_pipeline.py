from __future__ import annotations

import __spark_entry__ as entry_points
import corpus_pipeline
import pytest
from checks.compare import difference
from tests.llm.helpers import SCHEMA, documents, prose
from tidewatch.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    names = entry_points.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("key", sorted(queries.queries()))
def test_query_runs(spark, key):
    assert entry_points.queries()[key](spark, SF).count() > 0


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, key):
    assert difference(spark, SF, queries.queries()[key], queries.oracle_sql()[key]) is None


def test_pipeline_keeps_the_columns_and_the_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
    before = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.8 * before < out.count() <= before
    assert out.filter("not round_trip").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_documents(spark, name, stage):
    docs = spark.createDataFrame(documents(), SCHEMA).selectExpr("*", "1 as id", "'x' as kept", "'y' as doc")
    out = stage(spark, docs, SF)
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
    ids = {r["doc_id"] for r in out.collect()}
    gone = {"language_id": {6, 7, 8, 9}, "near_dedup": {1, 2, 11, 17}, "substring_dedup": {1, 17}}.get(name, set())
    assert ids == {r[0] for r in documents()} - gone
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeats_are_cut_from_the_text(spark):
    shared = prose(1, 30)
    rows = [(1, shared, "en", "s", 1), (2, f"new {shared} words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert out[1]["text"] == shared
    assert (out[2]["text"], out[2]["n_chars"]) == ("new words", 9)

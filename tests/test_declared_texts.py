"""Texts that are as declared are read by their types, with the rows of the field-by-field way."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import job_runs as jobs
from tidewatch.schema.source_types import RUN_TASK

AS_DECLARED = [
    '{"job_run_id": 1, "run_name": "a", "state": {"result_state": "S"}, "tasks": {"run_id": 5}}',
    '{"tasks": {"cluster_instance": {}, "run_id": -7}, "unknown": [1.50, {"x": 1}], "run_id": null}',
    '{"state": null, "schedule": {"quartz_cron_expression": "0 0 * * * ?"}, "run_name": "say \\"x\\""}',
    '{"state": {"user_cancelled_or_timedout": true, "state_message": "", "more": 1}}',
    "{}",
    ' {"job_id": 4}',
]
ODD = [
    '{"run_name": 1.50, "run_id": 1}',
    '{"run_name": 100000000000000000000000000000000000000000000, "job_id": 2}',
    '{"run_name": -0}',
    '{"run_name": {"b": 1.0, "a": 2}}',
    '{"run_name": [1, 2]}',
    '{"job_run_id": "12", "state": {"state_message": 1e3}}',
    '{"job_run_id": 1.5}',
    '{"job_run_id": 99999999999999999999}',
    '{"job_run_id": true, "tasks": {"run_id": "x"}}',
    '{"job_run_id": ""}',
    '{"state": "{\\"result_state\\": \\"FAILED\\"}", "job_id": 3}',
    '{"state": "not json"}',
    '{"state": "{}"}',
    '{"state": 5, "tasks": []}',
    '{"tasks": {"cluster_instance": "x"}}',
]
UNREAD = [
    '{"job_id": 1, "job_id": 2}',
    '{"state": {"result_state": "A", "result_state": "B"}}',
    '{"unknown": {"a": 1, "a": 2}}',
    '[{"job_id": 1}]',
    "{'job_id': 1}",
    '{"job_id": NaN}',
    '{"run_name": NaN}',
    '{"job_id": 1',
    "7",
    "null",
    "",
    None,
]
# Whatever comes after an object, both ways must take it alike.
AFTER = ['{"job_id": 1} x', '{"job_id": 1}{"job_id": 2}', '{"job_id": 1}}']


def messages(spark):
    texts = AS_DECLARED + ODD + UNREAD + AFTER
    return spark.createDataFrame(list(enumerate(texts)), "n int, message string")


def test_texts_as_declared_are_read_by_their_types(spark):
    parsed = messages(spark).withColumn("_parsed", F.try_parse_json("message"))
    read = jobs._as_declared(parsed, "message", T.StructType.fromDDL(RUN_TASK).fields)
    told = {r["n"]: r["_declared"] for r in read.select("n", "_declared").collect()}
    first_unread = len(AS_DECLARED) + len(ODD)
    assert [told[n] for n in range(first_unread)] == [True] * len(AS_DECLARED) + [False] * len(ODD)
    assert not any(told[first_unread + n] for n in range(len(UNREAD)))


def test_both_ways_give_the_same(spark, monkeypatch):
    def rows():
        return sorted(map(repr, jobs.decode_json(messages(spark)).collect()))

    by_type = rows()

    def none_as_declared(read, col, fields):
        typed = F.lit(None).cast(T.StructType(list(fields)))
        return read.withColumns({"_typed": typed, "_declared": F.lit(False), "_odd": F.col("_parsed")})

    monkeypatch.setattr(jobs, "_as_declared", none_as_declared)
    assert by_type == rows()

"""Day tables grow with the runs, also where the runs of a stretch are spread over many days."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans import run_days
from tidewatch.schema.source_types import RUN_TASK
from tidewatch.plans.job_events import shape_events
from checks.inputs import NOW


def test_a_run_costs_a_word_and_counts_once(spark):
    run = F.col("id") - 40
    day = (F.col("id") % 90) * 86_400_000 + 1000
    job = F.from_json(
        F.to_json(F.struct(run.alias("job_run_id"), day.alias("start_time"))), RUN_TASK
    ).alias("job")
    rows = spark.range(200).select(job)
    events = shape_events(rows, NOW, "https://x", nested=False)
    days = run_days.merge_days(run_days.run_days(events).unionByName(run_days.run_days(events)))
    width = F.length("runs") if days.schema["runs"].dataType == T.BinaryType() else F.lit(8)
    assert days.filter("dimension = 'all'").select(F.sum(width)).first()[0] <= 8 * 200
    assert run_days.totals_of_days(days).first()["total_runs"] == 200
    assert {r["n_runs"] for r in run_days.timeline_of_days(days).collect()} == {2, 3}

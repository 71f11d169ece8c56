"""Dashboard queries on nested and plain event tables, and stored ones."""

from __future__ import annotations

import pytest

from checks import inputs
from tidewatch.operators.job_runs import as_job, split_tasks
from tidewatch.plans import dashboards
from tidewatch.plans.job_events import shape_events

SF = "/root/testdata/sf0.001"
HOST = "https://x.cloud.databricks.com"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = inputs.task_rows(spark, SF)
    plain = shape_events(rows, inputs.NOW, HOST, nested=False)
    path = str(tmp_path_factory.mktemp("events") / "t")
    shape_events(rows, inputs.NOW, HOST).write.parquet(path)
    return plain, spark.read.parquet(path)


@pytest.mark.parametrize(
    "question",
    [
        dashboards.run_totals,
        dashboards.runs_timeline,
        dashboards.run_detail_table,
        dashboards.control_options,
        dashboards.run_trend,
        lambda t: dashboards.failed_job_alert(t, at_least=1),
        lambda t: dashboards.run_detail(
            dashboards.control_filter(t, {"job_name": ["job_1"], "job.state.result_state": ["FAILED"]})
        ),
    ],
)
def test_nested_and_plain_agree(tables, question):
    plain, nested = (question(table).collect() for table in tables)
    assert len(plain) > 0
    assert sorted(map(str, plain)) == sorted(map(str, nested))


def test_only_needed_columns_are_read(spark, tmp_path):
    inputs.runs(spark, SF).write.parquet(str(tmp_path / "runs"))
    rows = as_job(split_tasks(spark.read.parquet(str(tmp_path / "runs"))))
    plain = shape_events(rows, inputs.NOW, HOST, nested=False)
    plan = dashboards.control_options(plain)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "run_name" in read and "cluster_instance" in read
    assert not any(name in read for name in ("run_page_url", "schedule", "execution_duration"))

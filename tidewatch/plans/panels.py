"""Cluster dashboard panels over JMX samples.

Counters show their increase, gauges their range and last value.  Copies of a sample count
once where increases or samples are counted (``tsds_dedup``); the other panels show values that
copies do not change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.durations import spark_interval
from tidewatch.functions.mbeans import application_identity, driver_identity, executor_identity
from tidewatch.operators.metrics import match_catalogue, tsds_dedup
from tidewatch.operators.series import SERIES, counter_rate, of_kind, sampled_kind
from tidewatch.plans.metric_events import node_metrics

_DRIVER_GROUPS = ("driver.jobs.", "driver.stages.", "driver.tasks.", "driver.dag_scheduler.")
_EXECUTOR_GROUPS = ("executor.bytes.", "executor.records.", "executor.shuffle.")
_SPILL = ("executor.memory_bytes_spilled", "executor.disk_bytes_spilled")
_MEMORY_CPU = (
    "driver.executor_metrics.memory.jvm.heap",
    "driver.executor_metrics.memory.jvm.off_heap",
    "driver.jvm.cpu.time",
    "executor.memory.jvm.heap",
    "executor.memory.jvm.off_heap",
    "executor.jvm.cpu_time",
)
_GC_GAUGES = ("driver.executor_metrics.gc.", "executor.gc.")
_GC_TIME = "executor.jvm.gc_time"


def _starts_with_any(column: Column, prefixes: Sequence[str]) -> Column:
    return column.rlike("^(" + "|".join(p.replace(".", "[.]") for p in prefixes) + ")")


def _named(matched: DataFrame, identity: Column) -> DataFrame:
    """Add application and id; rows whose name cannot be read are error rows, not shown."""
    return (
        matched.withColumn("_identity", identity)
        .filter(F.col("_identity.application_name").isNotNull())
        .withColumn("application_name", F.col("_identity.application_name"))
        .withColumn("id", F.col("_identity.id"))
        .drop("_identity")
    )


def application_panel(samples: DataFrame) -> DataFrame:
    """Last runtime, cores and status per application.

    Folded per (application, status) first: values of fixed width keep the map-side
    aggregation a hash aggregation, and only few rows are left to pick from.
    """
    matched = match_catalogue(samples, ["application"])
    named = _named(matched, application_identity(F.col("mbean")))
    fields = {"runtime_ms": "application.runtime.ms", "cores": "application.cores"}

    def only(name: str, column: str) -> Column:
        return F.when(F.col("field") == fields[name], F.col(column))

    folded = named.groupBy("application_name", "status").agg(
        F.max(F.when(F.col("status").isNotNull(), F.col("ts"))).alias("status_at"),
        *(F.max(only(n, "ts")).alias(f"{n}_at") for n in fields),
        *(F.max_by(only(n, "value"), only(n, "ts")).alias(n) for n in fields),
    )
    return folded.groupBy("application_name").agg(
        *(F.max_by(n, f"{n}_at").try_cast("bigint").alias(n) for n in fields),
        F.max_by("status", "status_at").alias("status"),
    )


def _summary(samples: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Increase, range and last value per ``dims`` and field.

    Each series is folded on its own first, where times are unique; among series of one
    group sampled at the same time, the highest value counts as the last one.
    """
    delta = F.col("delta") if "delta" in samples.columns else F.lit(None).cast("double")
    per_series = samples.groupBy(*dict.fromkeys([*dims, *SERIES])).agg(
        F.sum(delta).alias("increase"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max("ts").alias("_last_at"),
        F.max_by("value", "ts").alias("_last"),
    )
    return per_series.groupBy(*dims, "field").agg(
        F.sum("increase").alias("increase"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.max(F.struct("_last_at", "_last"))["_last"].alias("last_value"),
    )


def driver_panel(samples: DataFrame) -> DataFrame:
    """Jobs, stages, tasks and scheduler of each application's driver."""
    matched = _named(match_catalogue(samples, ["driver"]), driver_identity(F.col("mbean")))
    shown = tsds_dedup(matched.filter(_starts_with_any(F.col("field"), _DRIVER_GROUPS)))
    rated = counter_rate(of_kind(shown, "counter"))
    gauges = of_kind(shown, "gauge")
    return (
        _summary(rated, ["application_name"])
        .unionByName(_summary(gauges, ["application_name"]))
        .select("application_name", "field", "increase", "last_value")
    )


def executor_panel(samples: DataFrame) -> DataFrame:
    """Bytes, records, shuffle and spill of each executor: increase, and rate at its peak."""
    matched = _named(match_catalogue(samples, ["executor"]), executor_identity(F.col("mbean")))
    wanted = _starts_with_any(F.col("field"), _EXECUTOR_GROUPS) | F.col("field").isin(list(_SPILL))
    rated = counter_rate(tsds_dedup(of_kind(matched.filter(wanted), "counter")))
    return rated.groupBy("application_name", "id", "field").agg(
        F.sum("delta").alias("increase"),
        F.max("rate").alias("peak_rate"),
        F.count("*").alias("n_samples"),
    )


def memory_cpu_panel(samples: DataFrame, every: str = "24h") -> DataFrame:
    """Heap, off-heap and CPU time per node and bucket, all read as gauges."""
    matched = match_catalogue(samples, ["driver", "executor"])
    shown = matched.filter(F.col("field").isin(list(_MEMORY_CPU)))
    gauges = of_kind(shown, "gauge", override_kind=sampled_kind())
    bucket = F.window("ts", spark_interval(every)).start
    return _summary(gauges.withColumn("bucket", bucket), ["host", "bucket"]).drop("increase")


def gc_panel(samples: DataFrame) -> DataFrame:
    """Collection counts and times per node: range of the gauges, increase of the total."""
    matched = match_catalogue(samples, ["driver", "executor"])
    gauges = tsds_dedup(matched.filter(_starts_with_any(F.col("field"), _GC_GAUGES)))
    spent = counter_rate(tsds_dedup(matched.filter(F.col("field") == _GC_TIME)))
    return _summary(gauges, ["host"]).unionByName(_summary(spent, ["host"]))


def node_panel(samples: DataFrame, every: str | None = None) -> DataFrame:
    """Workers alive and share of cores and memory in use, per node row."""
    rows = node_metrics(samples, every)
    cores, memory = "databricks.node.worker.cores", "databricks.node.worker.memory"

    def share(group: str) -> Column:
        used, free = F.col(f"{group}.used"), F.col(f"{group}.free")
        return F.try_divide(used.cast("double"), (used + free).cast("double"))

    workers = "databricks.node.main.workers"
    return rows.select(
        "host",
        "ts",
        F.col(f"{workers}.alive").alias("workers_alive"),
        F.col(f"{workers}.count").alias("workers_count"),
        share(cores).alias("cores_used_share"),
        share(memory).alias("memory_used_share"),
    )

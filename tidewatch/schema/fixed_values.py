"""Texts that must be exactly these for results to match existing tables."""

from __future__ import annotations

# Schema version and module stamped on every event.
ECS_VERSION = "8.11.0"
MODULE = "databricks"

# Constants of a job-run event.
JOB_STREAM_TYPE = "logs"
JOB_DATASET = "databricks.job_runs"
EVENT_KIND = "event"
EVENT_TYPE = "info"
EVENT_CATEGORY = "process"

# Constants of a metric event.
METRIC_STREAM_TYPE = "metrics"
METRIC_KIND = "metric"

# Job-run states and the outcome each result state maps to.
TERMINATED = "TERMINATED"
OUTCOMES = {"SUCCESS": "success", "FAILED": "failure", "CANCELED": "unknown"}

# Cluster id of a run without a cluster.
NO_CLUSTER = "Serverless"

# Text inside the workspace host that tells the cloud; the last match wins.
CLOUD_HOSTS = {
    "azuredatabricks.net": "azure",
    "cloud.databricks.com": "aws",
    "gcp.databricks.com": "gcp",
}

# Tag that keeps the original text, prefix of a pipeline error.
KEEP_ORIGINAL_TAG = "preserve_original_event"
JOB_ERROR_PREFIX = "Pipeline processing failed: "

# Default collection settings.
REQUEST_INTERVAL = "5m"
LOOKBACK = "5h"
SAMPLE_PERIOD = "60s"
MAX_LINES = 1000
LINE_TIMEOUT = "10s"

# First line of a log event.
LOG_EVENT_START = r"^\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"

# File names that hold logs, below the driver and executor log folders.
DRIVER_LOG_FILES = ("stdout*", "stderr*", "*.log", "*.out")
EXECUTOR_LOG_FILES = ("stdout*", "stderr*", "log4j-*.log")
LOG_DATASETS = {"driver": "spark.driver", "executor": "spark.executor"}

# Node system metric sets.
METRIC_SETS = (
    "cpu",
    "memory",
    "network",
    "filesystem",
    "process",
    "process_summary",
    "socket",
    "socket_summary",
    "diskio",
    "load",
    "uptime",
    "fsstat",
)

# Role names and the flag text that marks a driver node.
DRIVER_FLAG = "TRUE"
DRIVER_ROLE = "Driver"
EXECUTOR_ROLE = "Executor"

# Node facts stamped on log, metric and system rows.
NODE_FACTS = ("cluster_id", "container_ip", "instance_type", "cluster_name", "is_job_cluster")

# Older spelling of the metric datasets and the one in use.
OLD_DATASET_PREFIX = "apache_spark."
DATASET_PREFIX = "databricks.spark_"

# Dimensions every metric table shares.
SHARED_DIMENSIONS = (
    "agent.id",
    "cloud.account.id",
    "cloud.availability_zone",
    "cloud.instance.id",
    "cloud.provider",
    "cloud.region",
    "container.id",
    "host.name",
    "service.address",
)

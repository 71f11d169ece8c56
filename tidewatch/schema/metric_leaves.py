"""Declared metric leaves and the metric-name patterns that feed them.

Fixed values: the field paths, kinds, types, attributes and patterns below must be
exactly these for results to line up with existing tables.  One leaf per line:

    field  kind  type  attribute  pattern

``-`` means "none": dimensions and never-collected leaves have no pattern, and one
leaf (a status text) has no metric kind.
"""

from __future__ import annotations

from typing import NamedTuple


class MetricLeaf(NamedTuple):
    stream: str
    field: str
    kind: str | None
    type: str
    attribute: str | None
    pattern: str | None

    @property
    def path(self) -> str:
        """Field path below the stream name."""
        return self.field.split(".", 1)[1]

    @property
    def bean_type(self) -> str | None:
        """``type=`` part of the metric name that carries the attribute."""
        return BEAN_TYPES.get(self.attribute)


# Attribute read for each bean type.
BEAN_TYPES = {"Value": "gauges", "Count": "counters"}

# Fixed values.
_LEAVES = {
    "application": """
        application.cores  gauge  bigint  Value  application.*.cores
        application.mbean  dimension  string  -  -
        application.name  dimension  string  -  -
        application.runtime.ms  gauge  bigint  Value  application.*.runtime_ms
        application.status  -  string  Value  application.*.status
    """,
    "node": """
        node.main.applications.count  gauge  bigint  Value  master.apps
        node.main.applications.waiting  gauge  bigint  Value  master.waitingApps
        node.main.workers.alive  gauge  bigint  Value  master.aliveWorkers
        node.main.workers.count  gauge  bigint  Value  master.workers
        node.worker.executors  gauge  bigint  Value  worker.executors
        node.worker.cores.used  gauge  bigint  Value  worker.coresUsed
        node.worker.cores.free  gauge  bigint  Value  worker.coresFree
        node.worker.memory.used  gauge  bigint  Value  worker.memUsed_MB
        node.worker.memory.free  gauge  bigint  Value  worker.memFree_MB
    """,
    "executor": """
        executor.application_name  dimension  string  -  -
        executor.id  dimension  string  -  -
        executor.bytes.read  counter  bigint  Count  *.*.executor.bytesRead
        executor.bytes.written  counter  bigint  Count  *.*.executor.bytesWritten
        executor.mbean  dimension  string  -  -
        executor.memory.direct_pool  gauge  bigint  Value  *.*.ExecutorMetrics.DirectPoolMemory
        executor.memory.jvm.heap  gauge  bigint  Value  *.*.ExecutorMetrics.JVMHeapMemory
        executor.memory.jvm.off_heap  gauge  bigint  Value  *.*.ExecutorMetrics.JVMOffHeapMemory
        executor.memory.mapped_pool  gauge  bigint  Value  *.*.ExecutorMetrics.MappedPoolMemory
        executor.gc.major.count  gauge  bigint  Value  *.*.ExecutorMetrics.MajorGCCount
        executor.gc.major.time  gauge  bigint  Value  *.*.ExecutorMetrics.MajorGCTime
        executor.gc.minor.count  gauge  bigint  Value  *.*.ExecutorMetrics.MinorGCCount
        executor.gc.minor.time  gauge  bigint  Value  *.*.ExecutorMetrics.MinorGCTime
        executor.heap_memory.off.execution  gauge  bigint  Value  *.*.ExecutorMetrics.OffHeapExecutionMemory
        executor.heap_memory.off.storage  gauge  bigint  Value  *.*.ExecutorMetrics.OffHeapStorageMemory
        executor.heap_memory.off.unified  gauge  bigint  Value  *.*.ExecutorMetrics.OffHeapUnifiedMemory
        executor.heap_memory.on.execution  gauge  bigint  Value  *.*.ExecutorMetrics.OnHeapExecutionMemory
        executor.heap_memory.on.storage  gauge  bigint  Value  *.*.ExecutorMetrics.OnHeapStorageMemory
        executor.heap_memory.on.unified  gauge  bigint  Value  *.*.ExecutorMetrics.OnHeapUnifiedMemory
        executor.disk_bytes_spilled  counter  bigint  Count  *.*.executor.diskBytesSpilled
        executor.file_cache_hits  counter  bigint  Count  *.*.HiveExternalCatalog.fileCacheHits
        executor.files_discovered  counter  bigint  Count  *.*.HiveExternalCatalog.filesDiscovered
        executor.filesystem.file.large_read_ops  gauge  bigint  Value  *.*.executor.filesystem.file.largeRead_ops
        executor.filesystem.file.read_bytes  gauge  bigint  Value  *.*.executor.filesystem.file.read_bytes
        executor.filesystem.file.read_ops  gauge  bigint  Value  *.*.executor.filesystem.file.read_ops
        executor.filesystem.file.write_bytes  gauge  bigint  Value  *.*.executor.filesystem.file.write_bytes
        executor.filesystem.file.write_ops  gauge  bigint  Value  *.*.executor.filesystem.file.write_ops
        executor.filesystem.hdfs.large_read_ops  gauge  bigint  Value  *.*.executor.filesystem.hdfs.largeRead_ops
        executor.filesystem.hdfs.read_bytes  gauge  bigint  Value  *.*.executor.filesystem.hdfs.read_bytes
        executor.filesystem.hdfs.read_ops  gauge  bigint  Value  *.*.executor.filesystem.hdfs.read_ops
        executor.filesystem.hdfs.write_bytes  gauge  bigint  Value  *.*.executor.filesystem.hdfs.write_bytes
        executor.filesystem.hdfs.write_ops  gauge  bigint  Value  *.*.executor.filesystem.hdfs.write_ops
        executor.hive_client_calls  counter  bigint  Count  *.*.HiveExternalCatalog.hiveClientCalls
        executor.jvm.cpu_time  gauge  bigint  Value  *.*.JVMCPU.jvmCpuTime
        executor.jvm.gc_time  counter  bigint  Count  *.*.executor.jvmGCTime
        executor.memory_bytes_spilled  counter  bigint  Count  *.*.executor.memoryBytesSpilled
        executor.parallel_listing_job_count  counter  bigint  Count  *.*.HiveExternalCatalog.parallelListingJobCount
        executor.partitions_fetched  counter  bigint  Count  *.*.HiveExternalCatalog.partitionsFetched
        executor.process_tree.jvm.rss_memory  gauge  bigint  Value  *.*.ExecutorMetrics.ProcessTreeJVMRSSMemory
        executor.process_tree.jvm.v_memory  gauge  bigint  Value  *.*.ExecutorMetrics.ProcessTreeJVMVMemory
        executor.process_tree.other.rss_memory  gauge  bigint  Value  *.*.ExecutorMetrics.ProcessTreeOtherRSSMemory
        executor.process_tree.other.v_memory  gauge  bigint  Value  *.*.ExecutorMetrics.ProcessTreeOtherVMemory
        executor.process_tree.python.rss_memory  gauge  bigint  Value  *.*.ExecutorMetrics.ProcessTreePythonRSSMemory
        executor.process_tree.python.v_memory  gauge  bigint  Value  *.*.ExecutorMetrics.ProcessTreePythonVMemory
        executor.records.read  counter  bigint  Count  *.*.executor.recordsRead
        executor.records.written  counter  bigint  Count  *.*.executor.recordsWritten
        executor.result.size  counter  bigint  Count  *.*.executor.resultSize
        executor.result.serialization_time  counter  bigint  Count  *.*.executor.resultSerializationTime
        executor.run_time  counter  bigint  Count  *.*.executor.runTime
        executor.shuffle.client.used.direct_memory  gauge  bigint  Value  *.*.ExternalShuffle.shuffle-client.usedDirectMemory
        executor.shuffle.client.used.heap_memory  gauge  bigint  Value  *.*.ExternalShuffle.shuffle-client.usedHeapMemory
        executor.shuffle.server.used.direct_memory  gauge  bigint  -  -
        executor.shuffle.server.used.heap_memory  counter  bigint  -  -
        executor.shuffle.bytes_written  counter  bigint  Count  *.*.executor.shuffleBytesWritten
        executor.shuffle.fetch_wait_time  counter  bigint  Count  *.*.executor.shuffleFetchWaitTime
        executor.shuffle.local.blocks_fetched  counter  bigint  Count  *.*.executor.shuffleLocalBlocksFetched
        executor.shuffle.local.bytes_read  counter  bigint  Count  *.*.executor.shuffleLocalBytesRead
        executor.shuffle.records.read  counter  bigint  Count  *.*.executor.shuffleRecordsRead
        executor.shuffle.records.written  counter  bigint  Count  *.*.executor.shuffleRecordsWritten
        executor.shuffle.remote.blocks_fetched  counter  bigint  Count  *.*.executor.shuffleRemoteBlocksFetched
        executor.shuffle.remote.bytes_read  counter  bigint  Count  *.*.executor.shuffleRemoteBytesRead
        executor.shuffle.remote.bytes_read_to_disk  counter  bigint  Count  *.*.executor.shuffleRemoteBytesReadToDisk
        executor.shuffle.total.bytes_read  counter  bigint  Count  *.*.executor.shuffleTotalBytesRead
        executor.shuffle.write.time  counter  bigint  Count  *.*.executor.shuffleWriteTime
        executor.succeeded_tasks  counter  bigint  Count  *.*.executor.succeededTasks
        executor.threadpool.active_tasks  gauge  bigint  Value  *.*.executor.threadpool.activeTasks
        executor.threadpool.complete_tasks  gauge  bigint  Value  *.*.executor.threadpool.completeTasks
        executor.threadpool.current_pool_size  gauge  bigint  Value  *.*.executor.threadpool.currentPool_size
        executor.threadpool.max_pool_size  counter  bigint  Value  *.*.executor.threadpool.maxPool_size
        executor.threadpool.started_tasks  counter  bigint  Value  *.*.executor.threadpool.startedTasks
    """,
    "driver": """
        driver.application_name  dimension  string  -  -
        driver.job_duration  gauge  bigint  Value  *.driver.appStatus.jobDuration
        driver.jobs.failed  counter  bigint  Count  *.driver.appStatus.jobs.failedJobs
        driver.jobs.succeeded  counter  bigint  Count  *.driver.appStatus.jobs.succeededJobs
        driver.mbean  dimension  string  -  -
        driver.stages.completed_count  counter  bigint  Count  *.driver.appStatus.stages.completedStages
        driver.stages.failed_count  counter  bigint  Count  *.driver.appStatus.stages.failedStages
        driver.stages.skipped_count  counter  bigint  Count  *.driver.appStatus.stages.skippedStages
        driver.tasks.completed  counter  bigint  Count  *.driver.appStatus.tasks.completedTasks
        driver.tasks.executors.black_listed  counter  bigint  Count  *.driver.appStatus.tasks.blackListedExecutors
        driver.tasks.executors.excluded  counter  bigint  Count  *.driver.appStatus.tasks.excludedExecutors
        driver.tasks.executors.unblack_listed  counter  bigint  Count  *.driver.appStatus.tasks.unblackListedExecutors
        driver.tasks.executors.unexcluded  counter  bigint  Count  *.driver.appStatus.tasks.unexcludedExecutors
        driver.tasks.failed  counter  bigint  Count  *.driver.appStatus.tasks.failedTasks
        driver.tasks.killed  counter  bigint  Count  *.driver.appStatus.tasks.killedTasks
        driver.tasks.skipped  counter  bigint  Count  *.driver.appStatus.tasks.skippedTasks
        driver.disk.space_used  gauge  bigint  Value  *.driver.BlockManager.disk.diskSpaceUsed_MB
        driver.memory.max_mem  gauge  bigint  Value  *.driver.BlockManager.memory.maxMem_MB
        driver.memory.off_heap.max  gauge  bigint  Value  *.driver.BlockManager.memory.maxOffHeapMem_MB
        driver.memory.off_heap.used  gauge  bigint  Value  *.driver.BlockManager.memory.offHeapMemUsed_MB
        driver.memory.off_heap.remaining  gauge  bigint  Value  *.driver.BlockManager.memory.remainingOffHeapMem_MB
        driver.memory.on_heap.max  gauge  bigint  Value  *.driver.BlockManager.memory.maxOnHeapMem_MB
        driver.memory.on_heap.used  gauge  bigint  Value  *.driver.BlockManager.memory.onHeapMemUsed_MB
        driver.memory.on_heap.remaining  gauge  bigint  Value  *.driver.BlockManager.memory.remainingOnHeapMem_MB
        driver.memory.used  gauge  bigint  Value  *.driver.BlockManager.memory.memUsed_MB
        driver.memory.remaining  gauge  bigint  Value  *.driver.BlockManager.memory.remainingMem_MB
        driver.dag_scheduler.job.active  gauge  bigint  Value  *.driver.DAGScheduler.job.activeJobs
        driver.dag_scheduler.job.all  gauge  bigint  Value  *.driver.DAGScheduler.job.allJobs
        driver.dag_scheduler.stages.failed  gauge  bigint  Value  *.driver.DAGScheduler.stage.failedStages
        driver.dag_scheduler.stages.running  gauge  bigint  Value  *.driver.DAGScheduler.stage.runningStages
        driver.dag_scheduler.stages.waiting  gauge  bigint  Value  *.driver.DAGScheduler.stage.waitingStages
        driver.executors.all  gauge  bigint  Value  *.driver.ExecutorAllocationManager.executors.numberAllExecutors
        driver.executors.decommission_unfinished  counter  bigint  Count  *.driver.ExecutorAllocationManager.executors.numberExecutorsDecommissionUnfinished
        driver.executors.exited_unexpectedly  counter  bigint  Count  *.driver.ExecutorAllocationManager.executors.numberExecutorsExitedUnexpectedly
        driver.executors.gracefully_decommissioned  counter  bigint  Count  *.driver.ExecutorAllocationManager.executors.numberExecutorsGracefullyDecommissioned
        driver.executors.killed_by_driver  counter  bigint  Count  *.driver.ExecutorAllocationManager.executors.numberExecutorsKilledByDriver
        driver.executors.pending_to_remove  gauge  bigint  Value  *.driver.ExecutorAllocationManager.executors.numberExecutorsPendingToRemove
        driver.executors.to_add  gauge  bigint  Value  *.driver.ExecutorAllocationManager.executors.numberExecutorsToAdd
        driver.executors.max_needed  gauge  bigint  Value  *.driver.ExecutorAllocationManager.executors.numberMaxNeededExecutors
        driver.executors.target  gauge  bigint  Value  *.driver.ExecutorAllocationManager.executors.numberTargetExecutors
        driver.executor_metrics.memory.direct_pool  gauge  bigint  Value  *.driver.ExecutorMetrics.DirectPoolMemory
        driver.executor_metrics.memory.jvm.heap  counter  bigint  Value  *.driver.ExecutorMetrics.JVMHeapMemory
        driver.executor_metrics.memory.jvm.off_heap  counter  bigint  Value  *.driver.ExecutorMetrics.JVMOffHeapMemory
        driver.executor_metrics.memory.mapped_pool  gauge  bigint  Value  *.driver.ExecutorMetrics.MappedPoolMemory
        driver.executor_metrics.gc.major.count  gauge  bigint  Value  *.driver.ExecutorMetrics.MajorGCCount
        driver.executor_metrics.gc.major.time  gauge  bigint  Value  *.driver.ExecutorMetrics.MajorGCTime
        driver.executor_metrics.gc.minor.count  gauge  bigint  Value  *.driver.ExecutorMetrics.MinorGCCount
        driver.executor_metrics.gc.minor.time  gauge  bigint  Value  *.driver.ExecutorMetrics.MinorGCTime
        driver.executor_metrics.heap_memory.off.execution  gauge  bigint  Value  *.driver.ExecutorMetrics.OffHeapExecutionMemory
        driver.executor_metrics.heap_memory.off.storage  gauge  bigint  Value  *.driver.ExecutorMetrics.OffHeapStorageMemory
        driver.executor_metrics.heap_memory.off.unified  gauge  bigint  Value  *.driver.ExecutorMetrics.OffHeapUnifiedMemory
        driver.executor_metrics.heap_memory.on.execution  gauge  bigint  Value  *.driver.ExecutorMetrics.OnHeapExecutionMemory
        driver.executor_metrics.heap_memory.on.storage  gauge  bigint  Value  *.driver.ExecutorMetrics.OnHeapStorageMemory
        driver.executor_metrics.heap_memory.on.unified  gauge  bigint  Value  *.driver.ExecutorMetrics.OnHeapUnifiedMemory
        driver.executor_metrics.process_tree.jvm.rss_memory  gauge  bigint  Value  *.driver.ExecutorMetrics.ProcessTreeJVMRSSMemory
        driver.executor_metrics.process_tree.jvm.v_memory  gauge  bigint  Value  *.driver.ExecutorMetrics.ProcessTreeJVMVMemory
        driver.executor_metrics.process_tree.other.rss_memory  gauge  bigint  Value  *.driver.ExecutorMetrics.ProcessTreeOtherRSSMemory
        driver.executor_metrics.process_tree.other.v_memory  gauge  bigint  Value  *.driver.ExecutorMetrics.ProcessTreeOtherVMemory
        driver.executor_metrics.process_tree.python.rss_memory  gauge  bigint  Value  *.driver.ExecutorMetrics.ProcessTreePythonRSSMemory
        driver.executor_metrics.process_tree.python.v_memory  gauge  bigint  Value  *.driver.ExecutorMetrics.ProcessTreePythonVMemory
        driver.hive_external_catalog.file_cache_hits  counter  bigint  Count  *.driver.HiveExternalCatalog.fileCacheHits
        driver.hive_external_catalog.files_discovered  counter  bigint  Count  *.driver.HiveExternalCatalog.filesDiscovered
        driver.hive_external_catalog.hive_client_calls  counter  bigint  Count  *.driver.HiveExternalCatalog.hiveClientCalls
        driver.hive_external_catalog.parallel_listing_job.count  counter  bigint  Count  *.driver.HiveExternalCatalog.parallelListingJobCount
        driver.hive_external_catalog.partitions_fetched  counter  bigint  Count  *.driver.HiveExternalCatalog.partitionsFetched
        driver.jvm.cpu.time  gauge  bigint  Value  *.driver.JVMCPU.jvmCpuTime
        driver.spark.streaming.states.rows.total  gauge  bigint  Value  *.driver.spark.streaming.*.states-rowsTotal
        driver.spark.streaming.states.used_bytes  gauge  bigint  Value  *.driver.spark.streaming.*.states-usedBytes
        driver.spark.streaming.processing_rate.total  gauge  double  Value  *.driver.spark.streaming.*.processingRate-total
        driver.spark.streaming.latency  gauge  bigint  Value  *.driver.spark.streaming.*.latency
        driver.spark.streaming.event_time.watermark  gauge  bigint  Value  *.driver.spark.streaming.*.eventTime-watermark
        driver.spark.streaming.input_rate.total  gauge  double  Value  *.driver.spark.streaming.*.inputRate-total
    """,
}


def _parse() -> tuple[MetricLeaf, ...]:
    def cell(text: str) -> str | None:
        return None if text == "-" else text

    leaves = []
    for stream, table in _LEAVES.items():
        for line in table.strip().splitlines():
            field, kind, type_, attribute, pattern = line.split()
            leaves.append(
                MetricLeaf(stream, field, cell(kind), type_, cell(attribute), cell(pattern))
            )
    return tuple(leaves)


METRIC_LEAVES = _parse()
STREAMS = tuple(_LEAVES)


def leaves_of(stream: str) -> tuple[MetricLeaf, ...]:
    return tuple(leaf for leaf in METRIC_LEAVES if leaf.stream == stream)


def mapped_leaves(stream: str | None = None) -> tuple[MetricLeaf, ...]:
    """Leaves fed by a pattern (147 over all streams)."""
    return tuple(
        leaf
        for leaf in METRIC_LEAVES
        if leaf.pattern is not None and stream in (None, leaf.stream)
    )

"""Running a streaming DataFrame over what has landed so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything not processed yet and append the result to Parquet at ``path``.

    Called again after more data has landed, it goes on from the checkpoint.
    """
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(df: DataFrame, apply: Callable[[DataFrame, int], object], checkpoint: str) -> None:
    """Hand everything not processed yet to ``apply(rows, batch)``.

    After a failure the same rows come again under the same number, so ``apply`` has to skip
    batches it has finished (``BatchTables.once``).
    """
    query = (
        df.writeStream.foreachBatch(lambda rows, batch: apply(rows, batch) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

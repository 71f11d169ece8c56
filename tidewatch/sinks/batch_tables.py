"""Parquet tables that grow by numbered batches, each counted once.

The sink side of ``foreachBatch``: a batch's rows go to folders named after the batch and replace
what an attempt that failed has left there; the batch counts once its mark is set, after
everything it writes.  A batch that comes again is skipped.  Readers see marked batches only.

Tables of keys are spread over ``folders`` hash folders inside each batch, so that a batch reads
only the folders its own keys fall into.  ``fold`` merges the batches so far, after which readers
take the merged rows and the batches since.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDERS = 64
FOLDER = "folder"


def folder_of(*keys: str, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int").alias(FOLDER)


class BatchTables:
    """Tables below one folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def within(self, spark: SparkSession) -> BatchTables:
        """The same tables in another session, as ``foreachBatch`` hands it out."""
        return BatchTables(spark, self.root)

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, path: str, prefix: str = "") -> list[int]:
        """Numbers of the entries called ``prefix`` and a number; one name per batch."""
        files, path = self._at(path)
        if not files.exists(path):
            return []
        names = (status.getPath().getName() for status in files.listStatus(path))
        rest = (name.removeprefix(prefix) for name in names if name.startswith(prefix))
        return sorted(int(number) for number in rest if number.isdigit())

    def newest(self) -> int:
        """Number of the last batch that counts, -1 before the first."""
        return max(self._numbers("marks"), default=-1)

    def once(self, batch: int, apply: Callable[[], object]) -> bool:
        """Run ``apply`` and mark the batch, unless it or a later one is marked already."""
        if batch <= self.newest():
            return False
        apply()
        files, path = self._at(f"marks/{batch}")
        files.create(path, True).close()
        return True

    def write(self, name: str, batch: int, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Store a batch's rows; the same rows, read back."""
        path = f"{self.root}/{name}/batch={batch}"
        laid_out = rows.hint("rebalance", *by) if by else rows
        laid_out.write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(
        self, name: str, schema: str | T.StructType, folders: Sequence[int] | None = None
    ) -> DataFrame:
        """Rows of the batches that count, with their ``batch``; of these ``folders`` only."""
        newest = self.newest()
        folded = [n for n in self._numbers(f"{name}-folded", "batch=") if n <= newest][-1:]
        since = [n for n in self._numbers(name, "batch=") if n <= newest and [n] > folded]
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        rows = self.spark.createDataFrame([], T.StructType([*fields, T.StructField("batch", T.IntegerType())]))
        for part, numbers in ((f"{name}-folded", folded), (name, since)):
            if numbers:
                base = f"{self.root}/{part}"
                read = self.spark.read.schema(rows.schema).option("basePath", base)
                rows = rows.unionByName(read.parquet(*(f"{base}/batch={n}" for n in numbers)))
        return rows if folders is None else rows.filter(F.col(FOLDER).isin(list(folders)))

    def fold(
        self,
        name: str,
        schema: str | T.StructType,
        merge: Callable[[DataFrame], DataFrame],
        by: Sequence[str] = (),
    ) -> None:
        """Replace the batches so far, for readers, by ``merge`` of their rows."""
        newest = self.newest()
        merged = merge(self.read(name, schema)).drop("batch")
        merged.write.mode("overwrite").partitionBy(*by).parquet(
            f"{self.root}/{name}-folded/batch={newest}"
        )

"""Token counts as rollups maintained by signed deltas.

A store has, per committed batch, a ledger of signed rows (document, source, language,
tokenizer version, tokens, sign) and the sums of these rows by source, language and version.
A change takes back what the ledger holds for the document and version, and, unless it is a
delete, adds the new count; so inserts of known documents act as revisions, and deletes of
unknown ones do nothing.  Totals are the sums of the batches' sums: no document is read again.
The ledger lies in folders by a hash of the id, and a batch reads those its documents fall into.

A batch is written under its id, replacing what an attempt that failed has left, and counts
once its commit mark is written, last.  A batch already committed is not applied again.
Batches are applied one after the other.

Nulls in source, language and version are groups of their own.  Changes without a document id
or count are refused as ``rejected`` rows of the batch, deletes need no count.  Of several
changes of a document and version in a batch the last by ``seq`` holds; of equal ones a delete,
then the larger count.  An empty batch commits.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSERT, DELETE, REVISE = "insert", "delete", "revise"
GROUP = ("source", "lang", "tokenizer")
LEDGER = (
    "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, sign int, "
    "batch string, folder int"
)
FOLDERS = 64
SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"
MARKS = "batch string"


def words(text: Column) -> Column:
    """Runs without blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def word_pieces(text: Column) -> Column:
    """Runs of letters, runs of digits, and single other signs."""
    pattern = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def versions(tokenizers: dict[str, Callable[[Column], Column]], text: Column) -> Column:
    """``tokenizer, n_tokens`` of a text in each version, as an array."""
    return F.array(
        *(
            F.struct(F.lit(name).alias("tokenizer"), count(text).cast("long").alias("n_tokens"))
            for name, count in tokenizers.items()
        )
    )


def changes(counts: DataFrame, of: str, operation: str, seq: int = 0) -> DataFrame:
    """Changes: one row per document and entry of its ``versions`` in column ``of``."""
    return counts.select("doc_id", "source", "lang", F.inline(of)).select(
        "*", F.lit(operation).alias("operation"), F.lit(seq).alias("seq")
    )


def counted(
    docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]], operation: str, seq: int = 0
) -> DataFrame:
    """Changes: one row per document and tokenizer version."""
    counts = docs.select(
        "doc_id", "source", "lang", versions(tokenizers, F.col("text")).alias("counts")
    )
    return changes(counts, "counts", operation, seq)


class RollupStore:
    """Ledger, sums and commit marks below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        """All committed batches' rows; none before the first commit."""
        rows = self.spark.createDataFrame([], schema)
        for batch in self._marks():
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{part}/{batch}"))
        return rows

    def _marks(self) -> list[str]:
        """Ids of committed batches, in order; as many as there are batches."""
        try:
            marks = self.spark.read.schema(MARKS).json(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(row["batch"] for row in marks.distinct().collect())

    def ledger(self, folders: list[int] | None = None) -> DataFrame:
        """Signed rows of committed batches; of these folders only."""
        rows = self._read("ledger", LEDGER)
        return rows if folders is None else rows.filter(F.col("folder").isin(folders))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``; groups without documents are left out."""
        sums = self._read("sums", SUMS).groupBy(*GROUP)
        return sums.agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).filter("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; false if it was committed before."""
        if batch in self._marks():
            return False
        usable = F.col("doc_id").isNotNull() & F.col("operation").isin(INSERT, DELETE, REVISE)
        usable &= F.col("n_tokens").isNotNull() | (F.col("operation") == DELETE)
        usable = F.coalesce(usable, F.lit(False))
        columns = ("doc_id", *GROUP, "n_tokens", "operation", "seq")
        changes.select(*columns).filter(~usable).write.mode("overwrite").parquet(
            f"{self.root}/rejected/{batch}"
        )
        order = F.struct(
            "seq", (F.col("operation") == DELETE).alias("gone"), "n_tokens", "operation", "source", "lang"
        )
        last = changes.filter(usable).groupBy("doc_id", "tokenizer").agg(F.max(order).alias("new"))
        folder = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)).cast("int")
        touched = [r[0] for r in changes.filter(usable).select(folder).distinct().collect()]
        held = (
            self.ledger(touched)
            .groupBy("doc_id", *GROUP, "n_tokens")
            .agg(F.sum("sign").alias("copies"))
            .filter("copies <> 0")
        )
        touched = last.select("doc_id", F.col("tokenizer").alias("version"))
        taken = held.join(
            touched,
            (held["doc_id"] == touched["doc_id"]) & held["tokenizer"].eqNullSafe(touched["version"]),
            "left_semi",
        ).select("doc_id", *GROUP, "n_tokens", (-F.col("copies")).cast("int").alias("sign"))
        added = last.filter(F.col("new")["operation"] != DELETE).select(
            "doc_id",
            F.col("new")["source"].alias("source"),
            F.col("new")["lang"].alias("lang"),
            "tokenizer",
            F.col("new")["n_tokens"].alias("n_tokens"),
            F.lit(1).alias("sign"),
        )
        path = f"{self.root}/ledger/{batch}"
        signed = taken.unionByName(added).withColumns({"batch": F.lit(batch), "folder": folder})
        signed.hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(path)
        written = self.spark.read.schema(LEDGER).parquet(path)
        written.groupBy(*GROUP, "batch").agg(
            F.sum("sign").cast("long").alias("n_docs"),
            F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"),
        ).write.mode("overwrite").parquet(f"{self.root}/sums/{batch}")
        mark = self.spark.createDataFrame([(batch,)], MARKS)
        mark.coalesce(1).write.mode("append").json(f"{self.root}/commits")
        return True

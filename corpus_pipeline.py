"""The corpus pipeline: stages over documents, each calling one operator.

Each stage takes all documents its predecessor kept and returns documents with their columns;
the last adds what it encodes.  Documents with a null id pass near-duplicate removal, which judges
ids, and documents that share an id are kept or removed together there; all other stages judge
each row by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    decontamination,
    language_id,
    near_dedup,
    pieces,
    queries,
    substring_dedup,
)
from tidewatch.llm.common import land, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents in no learnt language: without a letter, or with unlikely ones."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit_language_model(
        language_id.training_rows(docs), queries.piece_model_path()
    )
    found = language_id.predict_language(docs, model)
    return found.filter(language_id.in_a_language()).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    found = near_dedup.near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; a document that is nothing else goes."""
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    return (
        substring_dedup.remove_repeats(docs.select(*COLUMNS))
        .filter(~cut | (F.col("n_removed") < F.col("n_words")))
        .withColumn("text", text)
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .select(*COLUMNS)
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    gone = decontamination.contaminated_pairs(docs, benchmark, whole=True).select("row").distinct()
    keyed = docs.select(*COLUMNS).withColumn("row", decontamination.row_key())
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding gives the text back."""
    path = queries.piece_model_path()
    encoded = pieces.encode_documents(docs.select(*COLUMNS), path)
    decoded = pieces.decode_documents(encoded, path)
    return decoded.select(
        *COLUMNS,
        "token_ids",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: SQL cannot express the language model, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat,
    decontamination,
    embedding_dedup,
    hard_negatives,
    language_id,
    near_dedup,
    pieces,
    running_tree,
    sharding,
    substring_dedup,
    token_rollups,
    toxicity,
    vector_codes,
)
from tidewatch.llm.common import id_remainder, land, read_table
from tidewatch.session import scratch_path

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    return public_tokenizers.path(PIECE_MODEL)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), whole=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = toxicity.training_rows(read_table(spark, sf_dir, "labels"))
    model = toxicity.fit_toxicity_model(docs, labels)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "flagged",
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = piece_model_path()
    return pieces.digests(pieces.decode_documents(pieces.encode_documents(docs, path), path))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, near_dedup.Similarity(words=2, percent=80))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_duplicate_vectors(vectors)


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = running_tree.score_texts(docs, id_remainder(F.col("doc_id"), 10) != 0)
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", words), (-7, 1, "assistant", words)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, those of low quality are counted anew without digits, toxic ones
    are taken out; the last batch arrives twice."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    store = token_rollups.RollupStore(spark, scratch_path(spark, "token-rollups"))
    tokenizers = {"words-1": token_rollups.words, "pieces-2": token_rollups.word_pieces}
    text = F.col("text")
    without_digits = F.regexp_replace(text, "[0-9]+", "")
    # Texts are counted where they are read; only counts are joined with labels.
    counts = land(
        docs.select(
            "doc_id",
            "source",
            "lang",
            token_rollups.versions(tokenizers, text).alias("whole"),
            token_rollups.versions(tokenizers, without_digits).alias("cleaned"),
        ),
        "token-counts",
    )
    poor = counts.join(labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    toxic = counts.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    store.commit("1-all", token_rollups.changes(counts, "whole", token_rollups.INSERT))
    store.commit("2-poor", token_rollups.changes(poor, "cleaned", token_rollups.REVISE))
    for _ in range(2):
        store.commit("3-toxic", token_rollups.changes(toxic, "whole", token_rollups.DELETE))
    return store.totals()


OP9_SQL = """
with counted as (
  select d.source, d.lang,
    case when exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0)
      then regexp_replace(d.text, '[0-9]+', '', 'g') else d.text end as body
  from documents d
  where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)
), versions as (
  select source, lang, 'words-1' as tokenizer,
    len(regexp_extract_all(coalesce(body, ''), '[^\\x20\\x09-\\x0D]+')) as n from counted
  union all
  select source, lang, 'pieces-2',
    len(regexp_extract_all(coalesce(body, ''), '\\p{L}+|\\p{N}+|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]'))
  from counted
)
select source, lang, tokenizer, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens
from versions group by source, lang, tokenizer
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_language_model(language_id.training_rows(docs), piece_model_path())
    return language_id.predict_language(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors, lambda id_: id_ % 50 == 0, label=label)


OP11_SQL = """
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    cast(list_inner_product(a.v, b.v) as bigint) as score
  from kept a join kept b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where a.vec_id % 50 = 0
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over best as integer) as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window best as (partition by anchor_id, positive_id order by score desc, other_id)
qualify row_number() over best <= 3
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codes = vector_codes.compress_vectors(vectors, carry=("label",))
    return vector_codes.with_label_errors(codes.rows).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(codes.digest()).alias("codebooks_sha256"),
    )


def _lloyd_sql(rounds: int = 2) -> str:
    assigned = """assigned{r} as materialized (
  select vec_id, part, min(cast(xx - 2 * list_inner_product(x, y) + yy as bigint) * 64 + entry) as best
  from cut join book{r} using (part) group by vec_id, part
)"""
    moved = """sums{r} as materialized (
  select part, best % 64 as entry, i, floor(sum(x[i]) / count(*)) as mean
  from assigned{r} join cut using (vec_id, part), range(1, width + 1) w(i)
  group by part, best % 64, i
), book{n} as materialized (
  select part, entry, y, list_inner_product(y, y) as yy from (
    select part, entry, list(coalesce(mean, y[i]) order by i) as y
    from (select part, entry, y, unnest(range(1, len(y) + 1)) as i from book{r})
    left join sums{r} using (part, entry, i) group by part, entry)
)"""
    steps = [assigned.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, n=r + 1), assigned.format(r=r + 1)]
    return """
with kept as (
  select vec_id, label, len(embedding) // 16 as width,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as materialized (
  select vec_id, part, width, x, list_inner_product(x, x) as xx from (
    select vec_id, part, width, v[part * width + 1 : (part + 1) * width] as x
    from kept, range(16) p(part))
), book0 as materialized (
  select part, entry, x as y, xx as yy from cut join (
    select vec_id, row_number() over (order by vec_id) - 1 as entry from kept
    order by vec_id limit 64) using (vec_id)
), """ + ", ".join(steps) + """, digest as (
  select sha256(string_agg(cast(cast(y[i] as bigint) as varchar), ',' order by part, entry, i)) as d
  from (select part, entry, y, unnest(range(1, len(y) + 1)) as i from book{n})
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  d as codebooks_sha256
from (
  select vec_id, string_agg(printf('%02x', best % 64), '' order by part) as code,
    cast(sum(best // 64) as bigint) as error
  from assigned{n} group by vec_id
) join kept using (vec_id), digest
""".format(n=rounds)


OP12_SQL = _lloyd_sql()


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_toxicity": op2_toxicity,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_near_dedup": op4_near_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_context_tree": op7_context_tree,
        "op8_chat": op8_chat,
        "op9_token_rollups": op9_token_rollups,
        "op10_language_id": op10_language_id,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_vector_codes": op12_vector_codes,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_token_rollups": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
    }

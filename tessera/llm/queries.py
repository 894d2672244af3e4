"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, bytebpe, chat, jaccard, langid, lm, negatives, packing, quality, sharding, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the same package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_link_graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", quality.compression_bands("text").alias("q")).select("doc_id", "q.*")


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chat.perspectives(table(spark, sf_dir, "conversations"))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return got.withColumn("spans", shown)


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op12_rotated_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, replace(replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS text
  FROM conversations
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat_ws(chr(10), speaker, text))) - 1 AS r FROM rows
), who AS (
  SELECT DISTINCT conv_id, speaker AS assistant FROM rows WHERE speaker <> 'system'
), pieces AS (
  SELECT r.conv_id, w.assistant, CAST(r // 64 AS INTEGER) AS segment, r.r, r.speaker = w.assistant AS own,
         CASE WHEN r.speaker = w.assistant THEN '<|assistant|>' || chr(10)
              WHEN r.speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || r.speaker || '|>' || chr(10) END AS head,
         r.text || '<|end|>' || chr(10) AS body
  FROM ranked r JOIN who w ON r.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, assistant, segment ORDER BY r) - length(body) AS begin_at FROM pieces
)
SELECT conv_id, assistant, segment, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body, '' ORDER BY r) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(begin_at AS BIGINT) || '-' || CAST(begin_at + length(body) AS BIGINT) END, ',' ORDER BY r), '') AS spans
FROM placed GROUP BY conv_id, assistant, segment
"""

OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_genetic_packing, op2_viterbi_language, op3_parity_sketch_join, op4_link_graph_verdicts, op5_compression_bands,
    op6_transducer_bpe, op7_prefix_forest, op8_context_mixing, op9_hypergeometric_shards, op10_perspective_rotation,
    op11_byte_level_bpe, op12_rotated_hard_negatives,
)}
ORACLES: dict[str, str] = {"op10_perspective_rotation": OP10_SQL, "op12_rotated_hard_negatives": OP12_SQL}

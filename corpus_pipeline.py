"""The training-data pipeline over ``documents``: stages, each written as Parquet and read again.

Each stage works on all that its predecessor kept. The quality rules, language ID and the near-duplicate join drop documents and
return the columns of ``documents``; the last stage returns the pieces that the documents are packed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, langid, packing, quality, queries


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word that the compression bands and the limit on repeated words keep; short ones have wide bands and stay."""
    (q,) = common.unused(docs, "q")
    return quality.quality(docs, out=q, min_words=1).where(F.col(f"{q}.kept")).drop(q)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 and more)."""
    return jaccard.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and where they lie in sequences of up to 1,024 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs)
            scratch.drop(before)
    return docs


#: SQL has no compression, tokenizer or genetic search; tests hold the stages against brute force.
ORACLE_SQL = None

"""A corpus pipeline of five stages, each an operator of ``newsloom.llm`` over all that the one before kept.

Rows with a null id can't be told apart: they pass the stages that drop documents by id. An empty table gives empty stages, and without labels or
benchmark items nothing is dropped by them. Columns that the tables have besides those of ``documents`` pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from newsloom.llm.common import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter("keep").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go, but in one; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id isn't in ``gone``; those without an id stay where they are."""
    kept = docs.filter("doc_id IS NOT NULL").join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id stays; rows with a null id stay."""
    groups = jaccard_join.similar_groups(docs)
    others = groups.filter(F.col("doc") != F.col("component")).select(F.col("doc").alias("doc_id")).distinct()
    return without(docs, others)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; rows with a null id can't be told apart and stay."""
    found = decontaminate.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter(F.size("items") > 0).select(F.col("doc").alias("doc_id")).distinct()
    return without(docs, hit)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(spark, docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, keep_text=False)
    return bpe.decode(spark, coded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the merges of byte-level BPE, nor the fitted classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

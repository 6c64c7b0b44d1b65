"""Cleaning pipeline over ``documents``: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import jaccard, mixing, quality, scratch, secrets, tokens, wfst


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "doc_id"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, carry=_others(docs)).filter("kept").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return jaccard.deduplicated(docs).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of secrets are masked in its text, and ``n_chars`` follows."""
    found = secrets.scan(docs, carry=[c for c in _others(docs) if c not in ("text", "n_chars")])
    masked = found.withColumn("text", secrets.redacted()).withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes of them: none, one or two."""
    mixed = mixing.mix(docs, carry=[c for c in _others(docs)])
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0)).cast("int")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left."""
    return wfst.encode(docs, tokens.model_path()).select("doc_id", "ids", "n_tokens")


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]
STAGES: list[Stage] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", sentencepiece),
]

#: The classifier, the pieces and the seeded fit of budgets have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.stash(docs, "stage")
            if used is not None:
                scratch.discard(used)
            used = docs
    return docs

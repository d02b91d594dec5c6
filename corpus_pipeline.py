"""A corpus prepared in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.llm import bpe, exact, minhash, mixing, toxicity
from likewise.sources.staging import stage

#: Domains by quality, and the share of the tokens that each should have in the end.
WEIGHTS = {"good": 0.88, "poor": 0.12}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are scored as toxic."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts: that of the largest doc_id."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (Jaccard 0.8 or more): that of the smallest doc_id."""
    return minhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of domains that are too rare more often."""
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    labelled = _labels(spark, sf_dir).select("doc_id", quality.alias("domain"))
    return mixing.resample(docs, labelled, WEIGHTS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the texts, and whether they decode to the same bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    whole = F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == whole).alias("round_trip"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: The stages learn models and replay merges, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

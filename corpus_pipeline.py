"""The corpus pipeline: from ``documents`` to the token digests of the documents that stay.

Toxic documents go, then all but one of each group of equal texts, all but one of each group of
near copies, and documents that hold a benchmark passage; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm import decontam, dedup, jaccard, queries, toxicity
from gridspark.llm.common import crc_mod, ready
from gridspark.runtime import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, judged by labelled ones that are not held out."""
    ready(spark)
    learn = ~F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    index = toxicity.fit(docs.where(learn), _table(spark, sf_dir, "labels").where(learn))
    return toxicity.not_toxic(docs, index)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ready(spark)
    return dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ready(spark)
    return jaccard.one_per_group(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    ready(spark)
    return decontam.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of what they decode to."""
    ready(spark)
    return queries.token_digests(docs)


STAGES = [("toxicity", not_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", no_benchmark), ("byte_bpe", encode)]

# SQL can neither learn from the labels nor encode; the result is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages one after the other to ``documents``; each reads what the one before has written."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs

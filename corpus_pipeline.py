"""The corpus pipeline: five stages, each over all that its predecessor kept.

1. quality: documents that the classifier rejects go (trained on `labels` and the documents at hand).
2. near copies: one document of each component of word 5-grams with a Jaccard similarity of 0.8 or more stays.
3. decontamination: documents in which a window of the benchmark occurs go.
4. mixing: documents are sampled with calibrated probabilities towards the target marginals.
5. sharding: every document gets a shard; bytes, tokens and rows are balanced.

All but the last return the columns of documents. Every stage's rows are written to the shared
folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm.common import read, store
from lattix.llm.decontaminate import decontaminate
from lattix.llm.mix import mix_documents
from lattix.llm.ngram_join import drop_near_copies
from lattix.llm.quality import THRESHOLD, quality
from lattix.llm.shard import assign_shards


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality(docs, read(spark, sf_dir, "labels"), "_lattix_quality")
    return scored.where(F.col("_lattix_quality") >= THRESHOLD).drop("_lattix_quality")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES = [("quality", keep_quality), ("near copies", keep_one_copy), ("decontamination", keep_clean), ("mixing", mix), ("sharding", shard)]

#: Trained models, sampling and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs

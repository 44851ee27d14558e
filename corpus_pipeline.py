"""The corpus pipeline: documents of quality, once each, mixed to target weights and packed.

Every stage takes the documents that the one before kept and returns those it keeps, with the
same columns; the last returns where each piece of a document lies in the bins. Each result
is written to the shared folder and read again, so that a lost executor costs one stage at
most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entivore.llm import exact_dedup, mixing, ngram_join, packing, quality_rank
from entivore.llm.common import stored, table

#: Near copies share 80 % or more of their five-word shingles (op8's own setting is stricter).
NEAR_N, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rank.filtered(docs, quality_rank.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=NEAR_N, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mix", mix), ("pack", pack)]

#: Learned weights and best-fit bins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality rules, SimHash near-dedup, PII, mixing and packing, one after the other, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, pii, quality, simhash
from millrace.llm.common import table
from millrace.sources.shared import shared_folder


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


#: Each stage's result is written as Parquet and read again as the next one's documents.
STAGES = [
    ("quality_rules", _quality),
    ("simhash_near_dedup", _near_dedup),
    ("pii", _pii),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: Near copies are found by hashes that SQL does not have; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = shared_folder(spark, f"stage-{k}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs

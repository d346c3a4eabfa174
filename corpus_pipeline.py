"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, neardup, packing, quality, secrets
from tallyspark.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the repetition limits go, and those of more than one symbol in two words."""
    return quality.keep_good(docs, quality.RepetitionRules(symbol_limit=0.5))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked at 0.8 over five-word shingles: the one with the smallest id."""
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced by a mark."""
    return secrets.redact(docs, secrets.fit(secrets.windows(docs)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of their sources takes them: repeated, whole or in part."""
    return mixing.mixed_documents(docs, mixing.plan_mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the packed sequences; copy tells the rows apart that the mix made of one document."""
    pieces = packing.token_pieces(docs)
    return packing.number_copies(packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Rolling hashes, minhashes, a trained field and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training-data pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage reads the columns of documents, whatever else its input has, and treats every row that its predecessor kept:
a very long text whole, a repeated row like any other, an empty table as an empty result. What null and empty texts, null
ids and ties come to is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontamination, mixing, near_dup, quality_rules, sharding
from threadloom.llm.queries import MIX_DOMAINS, mix_weights
from threadloom.session import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed. Null and empty texts fail; ids don't matter."""
    judged = quality_rules.assess_quality(docs.select(*COLUMNS), out="__verdict")
    clean = judged.filter("__verdict.kept").withColumn("text", F.col("__verdict.clean_text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, the one with the least id.

    Null and empty texts are like nothing and stay, and so do rows without an id; of rows with one id a single one stays."""
    return near_dup.drop_near_duplicates(docs.select(*COLUMNS), n=near_dup.STAGE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none and stay, whatever their ids."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit the token budgets of their domain, language and source, at the target weights; each once.

    A null language or source is one of its own; null and empty texts cost a token; rows that tie go together."""
    domain = mixing.domain_of(F.col("source"), MIX_DOMAINS)
    return mixing.mix_sources(docs.select(*COLUMNS), domain, mix_weights(spark), budget_percent=80, max_epochs=1).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it, null and empty texts too; rows that tie stand in any order."""
    return sharding.shard_documents(docs.select(*COLUMNS)).select(*COLUMNS, "placement.shard", "placement.slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Near-duplicate groups and the seeded choices are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs

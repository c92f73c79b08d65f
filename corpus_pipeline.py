"""A training corpus from raw documents: rules, near-duplicates, benchmark passages, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and hands
the written table to the next. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trigrove.llm import decontaminate, mixture, neardup, quality, sharding
from trigrove.llm.queries import table
from trigrove.plans.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rule_filtered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judged(docs, quality.trusted(table(spark, sf_dir, "labels")))
    return judged.where("kept").select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates: 5-word shingles, similarity 0.8."""
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    found = decontaminate.digest(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.where("not contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the curriculum takes them, in training order."""
    return mixture.curriculum(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and the slot that the uniform shuffle gives them."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rule_filtered),
    ("near-duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixture", mixed),
    ("sharding", sharded),
]

#: Sketches, likelihood ratios and hypergeometric draws are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs

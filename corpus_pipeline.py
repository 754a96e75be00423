"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubewise.llm import stages
from cubewise.llm.scratch import Scratch, read_table

#: Each stage takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [
    ("quality", stages.quality_filter),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("benchmark_passages", stages.benchmark_passages),
    ("pack", stages.pack),
]

#: The stages learn, hash and search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs

"""The corpus pipeline: quality rules, near duplicates, substring dedup, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pamsieve.llm import pipeline_stages as stages
from pamsieve.llm._io import cut

STAGES = [
    ("quality rules", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("substring dedup", stages.substrings),
    ("secret scans", stages.secrets),
    ("packing", stages.packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other; each one's output is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

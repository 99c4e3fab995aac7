"""Document pipeline: classifier, near-dedup, repeat removal, decontamination, BPE round trip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import stages
from siteloom.llm.common import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", stages.quality_classifier),
    ("minhash_near_dedup", stages.near_dedup),
    ("suffix_array_dedup", stages.repeat_removal),
    ("benchmark_decontamination", stages.decontamination),
    ("bpe_round_trip", stages.bpe_round_trip),
]

#: The stages are no SQL: tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs

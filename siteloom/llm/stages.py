"""Stages of the document pipeline: each takes and returns the columns of ``documents``, the last one digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, quality, repeats, tiling
from .common import few_files
from .q_bpe import round_trip
from .registry import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more."""
    own = docs.columns
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="_score").where("_score >= 0.5").select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), and one row of each id; rows without id stay.

    Of several rows of one id the one with the smallest text stays, then with the smallest other columns.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), k=5, num=80, den=100)
    gone = few_files(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "copies")
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").limit(1)
    if twice.isEmpty():
        return left
    others = F.to_json(F.struct(*(c for c in docs.columns if c != "text")))
    one = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", others)).alias("row")).select("row.*")
    return one.unionByName(left.where("doc_id IS NULL"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier repeat covers; n_chars follows."""
    out = repeats.drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))

"""Distinct counts over many crawls from sketches that are kept with each crawl.

The exact analyses count distinct values of the crawls at hand. Over all crawls of a store that means reading
every link again; a sketch of some kilobytes per crawl answers it from the sketches alone, within the error of
HyperLogLog (about 1.04 / sqrt(2 ** lg_k) of the count, one standard deviation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Binary logarithm of the number of registers: 2 ** 14 give a standard error below 1 %.
LG_K = 14


def sketch(rows: DataFrame, lg_k: int = LG_K, **values: Column | str) -> DataFrame:
    """(crawl_id, measure, sketch): one sketch per crawl and named value of ``rows``; nulls do not count.

    Partial sketches are merged, not rows, so a crawl that holds most rows is spread over all tasks. All
    measures are read in one pass. Sketches of several calls can be stored in one table.
    """
    made = rows.groupBy("crawl_id").agg(*[
        F.hll_sketch_agg(F.col(v) if isinstance(v, str) else v, lg_k).alias(name) for name, v in values.items()])
    return made.select("crawl_id", F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).alias("sketch")) for name in values])))


def link_sketches(links: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Sketches of targets, target hosts and linking pages of ``analysis.link_facts``."""
    return sketch(links, lg_k, targets="link", target_hosts="host", linking_pages="url")


def image_sketches(crawl: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Sketches of the distinct image addresses of each crawl."""
    return sketch(crawl.select("crawl_id", F.explode("images.src").alias("src")), lg_k, images="src")


def distinct_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n): estimated distinct values of the crawls in each group, of all crawls without keys."""
    return sketches.groupBy(*keys, "measure").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))

"""Crawl hosts, internal links and the indexable map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import urls
from siteloom.session import materialise


def crawl_hosts(crawl: DataFrame) -> DataFrame:
    """(crawl_id, host, pages, first_seq): one row per host a crawl fetched from."""
    return (
        crawl.where("url <> ''").select("crawl_id", "seq", urls.host("url").alias("host"))
        .groupBy("crawl_id", "host")
        .agg(F.count("*").alias("pages"), F.min("seq").alias("first_seq"))
    )


def hosts_table(crawl: DataFrame) -> DataFrame:
    """``crawl_hosts`` written once: its size tells Spark whether link joins can broadcast it."""
    return materialise(crawl_hosts(crawl), "hosts")


def primary_hosts(hosts: DataFrame) -> DataFrame:
    """Most frequent host of every crawl, the first seen on ties."""
    best = F.max_by("host", F.struct(F.col("pages"), -F.col("first_seq")))
    return hosts.groupBy("crawl_id").agg(best.alias("primary_host"), F.max("pages").alias("pages"))


def keep_internal(df: DataFrame, hosts: DataFrame, host: str, page_host: str) -> DataFrame:
    """Rows whose ``host`` the crawl fetched from.

    A link to the host of its own page is internal as it stands. Those rows,
    the bulk of any crawl, get scattered keys no host can equal ('/' never
    occurs in a host), so that the lookup has no hot key for a site's own host.
    """
    same = F.col(host) == F.col(page_host)
    scattered = F.concat(F.lit("//"), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(4096)))
    known = hosts.select("crawl_id", F.col("host").alias("_key"), F.lit(True).alias("_known"))
    return (
        df.withColumn("_key", F.when(same, scattered).otherwise(F.col(host)))
        .join(known, ["crawl_id", "_key"], "left")
        .where(same | F.col("_known")).drop("_key", "_known")
    )


def indexable() -> Column:
    """Status 200 and no noindex in the robots meta."""
    noindex = F.coalesce(F.lower("meta_robots").contains("noindex"), F.lit(False))
    return F.coalesce(F.col("status") == 200, F.lit(False)) & ~noindex


def index_map(crawl: DataFrame) -> DataFrame:
    """(crawl_id, target, indexable) by slash-trimmed URL; the last fetch of a URL decides."""
    return (
        crawl.select("crawl_id", "seq", urls.loose_form("url").alias("target"), indexable().alias("ok"))
        .groupBy("crawl_id", "target").agg(F.max_by("ok", "seq").alias("indexable"))
    )

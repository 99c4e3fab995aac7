"""Checks with one answer per crawl: robots file, sitemap, site-wide markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteloom.functions import constants as K
from siteloom.plans.graph_checks import as_findings
from siteloom.sources.robots import robots_lines


def robots_syntax(robots: DataFrame) -> DataFrame:
    """4: lines no robots parser knows."""
    bad = robots_lines(robots).where(
        (F.col("text") != "")
        & (F.col("directive").isNull() | ~F.col("directive").isin(*K.ROBOTS_DIRECTIVES)))
    shown = F.concat(F.lit("line "), F.col("line_no"), F.lit(": "),
                     F.substring(F.trim("line"), 1, K.ROBOTS_LINE_SHOWN))
    return as_findings(bad, 4, seq="line_no", url=shown)


def robots_presence(crawls: DataFrame, robots: DataFrame) -> DataFrame:
    """5 and 38: no robots text, no Sitemap line; only where a fetch was attempted."""
    # Of several files of a crawl the longest text counts.
    bodies = robots.groupBy("crawl_id").agg(F.max_by("body", F.length("body")).alias("body"))
    asked = crawls.where("robots_url IS NOT NULL").select("crawl_id", "robots_url").join(
        bodies, "crawl_id", "left")
    body = F.coalesce("body", F.lit(""))
    missing = F.when(F.trim(F.regexp_replace(body, r"\s", " ")) == "", F.lit(5))
    no_sitemap = F.when(~body.rlike(r"(?im)^\s*sitemap\s*:"), F.lit(38))
    hits = asked.select("crawl_id", "robots_url", F.explode(F.array_compact(F.array(missing, no_sitemap))).alias("num"))
    return as_findings(hits, F.col("num"), seq=F.lit(0), url="robots_url")


def markup_types(crawl: DataFrame, primaries: DataFrame) -> DataFrame:
    """31 and 32: the crawl has typed markup but none of the wanted type."""
    types = F.filter(F.map_entries("jsonld"), lambda e: F.lower(e["key"]).endswith("@type"))

    def found(name: str):
        return F.exists(types, lambda e: F.lower(e["value"]).contains(name))

    per_crawl = crawl.groupBy("crawl_id").agg(
        F.bool_or(F.size(types) > 0).alias("typed"),
        F.bool_or(found("organization")).alias("org"), F.bool_or(found("localbusiness")).alias("local"))
    nums = F.array_compact(F.array(F.when(~F.col("org"), F.lit(31)), F.when(~F.col("local"), F.lit(32))))
    missing = per_crawl.where("typed").select("crawl_id", F.explode(nums).alias("num")).join(
        primaries, "crawl_id", "left")
    site = F.coalesce(F.nullif("primary_host", F.lit("")), F.lit("site"))
    return as_findings(missing, F.col("num"), seq=F.lit(0), url=site)


def sitemap_size(crawls: DataFrame, sitemap: DataFrame) -> DataFrame:
    """58 and 77: too many rows, or none where robots.txt was asked for."""
    counts = sitemap.groupBy("crawl_id").agg(F.count("*").alias("n"))
    sizes = crawls.select("crawl_id", "robots_url").join(counts, "crawl_id", "left")
    num = F.when(F.col("n") > K.SITEMAP_URL_LIMIT, 58).when(
        F.col("n").isNull() & F.col("robots_url").isNotNull(), 77)
    return as_findings(sizes.withColumn("num", num).where("num IS NOT NULL"), F.col("num"), seq=F.lit(0),
                       url=F.coalesce("robots_url", F.lit("sitemap")))


def sitemap_errors(sitemap: DataFrame) -> DataFrame:
    """78: every parse error of the sitemap."""
    errors = sitemap.where("errors IS NOT NULL").select("crawl_id", "seq", "errors")
    return as_findings(errors, 78, url="errors")

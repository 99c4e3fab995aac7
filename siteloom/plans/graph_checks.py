"""Checks that compare pages with each other: joins on URL or host, and ordered groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import urls
from siteloom.functions import constants as K
from siteloom.operators import hosts as H
from siteloom.operators.groups import previous_in_group


def narrow(crawl: DataFrame) -> DataFrame:
    """What the checks that compare pages read of a crawl; of the text only whether it is thin."""
    return crawl.select(
        "crawl_id", "seq", "url", "status", "canonical", "meta_robots",
        F.substring("body_text", 1, K.THIN_BODY_CHARS).alias("body_text"),
        F.transform("links", lambda k: F.struct(k["url"].alias("url"), k["nofollow"].alias("nofollow"))).alias("links"))


def as_findings(df: DataFrame, num: int | Column, rank=None, seq="seq", pos=None, url="url", basis="crawl") -> DataFrame:
    return df.select(
        "crawl_id",
        (F.lit(num) if isinstance(num, int) else num).alias("num"),
        F.lit(basis).alias("basis"),
        (F.lit(0) if rank is None else F.col(rank)).cast("bigint").alias("rank"),
        (F.col(seq) if isinstance(seq, str) else seq).cast("bigint").alias("seq"),
        (F.lit(0) if pos is None else F.col(pos)).cast("int").alias("pos"),
        (F.col(url) if isinstance(url, str) else url).alias("url"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def canonical_to_non_indexable(crawl: DataFrame, index: DataFrame) -> DataFrame:
    """6: the canonical names a crawled page that is not indexable."""
    pages = crawl.where("canonical <> ''").select(
        "crawl_id", "seq", "url", urls.loose_form("canonical").alias("target"))
    return as_findings(pages.join(index.where("NOT indexable"), ["crawl_id", "target"], "left_semi"), 6)


def canonical_to_other_site(crawl: DataFrame, hosts: DataFrame, primaries: DataFrame) -> DataFrame:
    """9 and 24: the canonical's host was never crawled; 24 also wants a named primary host."""
    pages = crawl.where("canonical <> ''").select("crawl_id", "seq", "url", urls.host("canonical").alias("host")).where(
        (F.col("host") != "") & (F.col("host") != F.coalesce(urls.host("url"), F.lit(""))))
    foreign = pages.join(hosts.select("crawl_id", "host"), ["crawl_id", "host"], "left_anti")
    named = primaries.where("primary_host <> ''").select("crawl_id", F.lit(True).alias("named"))
    nums = F.when(F.col("named"), F.array(F.lit(9), F.lit(24))).otherwise(F.array(F.lit(9)))
    both = foreign.join(named, "crawl_id", "left").withColumn("num", F.explode(nums))
    return as_findings(both, F.col("num"))


def nofollow_to_indexable(crawl: DataFrame, hosts: DataFrame, index: DataFrame) -> DataFrame:
    """66: a nofollow link to an own indexable page; one row per page."""
    nofollow = F.filter("links", lambda k: F.coalesce(k["nofollow"], F.lit(False)))
    links = crawl.select(
        "crawl_id", "seq", "url", urls.host("url").alias("page_host"),
        F.explode(F.array_distinct(F.transform(nofollow, lambda k: k["url"]))).alias("link"),
    ).select("crawl_id", "seq", "url", "page_host", urls.host("link").alias("host"),
             urls.loose_form("link").alias("target"))
    own = H.keep_internal(links, hosts, "host", "page_host").select("crawl_id", "seq", "url", "target")
    hit = own.join(index.where("indexable"), ["crawl_id", "target"], "left_semi")
    return as_findings(hit.select("crawl_id", "seq", "url").distinct(), 66)


def indexable_url_patterns(crawl: DataFrame, index: DataFrame) -> DataFrame:
    """67 and 68: search pages and session URLs that are indexable."""
    search = F.when(F.col("url").rlike(K.SEARCH_PATH), F.lit(67))
    session = F.when(urls.has_param("url", K.SESSION_PARAMS), F.lit(68))
    pages = crawl.select(
        "crawl_id", "seq", "url", urls.loose_form("url").alias("target"),
        F.explode(F.array_compact(F.array(search, session))).alias("num"))
    return as_findings(
        pages.join(index.where("indexable"), ["crawl_id", "target"], "left_semi"), F.col("num"))


def thin_sitemap_pages(crawl: DataFrame, sitemap: DataFrame) -> DataFrame:
    """37: listed in the sitemap, answers 200, carries little text."""
    thin = crawl.where(
        (F.col("status") == 200)
        & (F.coalesce(F.length("body_text"), F.lit(0)) < K.THIN_BODY_CHARS)
    ).select("crawl_id", "seq", "url")
    locs = sitemap.select("crawl_id", F.col("loc").alias("url"))
    return as_findings(thin.join(locs, ["crawl_id", "url"], "left_semi"), 37)


def sitemap_orphans(crawl: DataFrame, sitemap: DataFrame, crawls: DataFrame) -> DataFrame:
    """91: sitemap URLs neither fetched nor linked, in crawls that followed links."""
    discovery = crawls.where("is_discovery").select("crawl_id")
    locs = sitemap.join(discovery, "crawl_id", "left_semi").select(
        "crawl_id", "seq", "loc", urls.loose_form("loc").alias("target"))
    seen = F.concat(F.array("url"), F.transform("links", lambda k: k["url"]))
    # Deduplicated per page and per task before the shuffle: a home page may be every second link.
    known = crawl.join(discovery, "crawl_id", "left_semi").select(
        "crawl_id", F.explode(F.array_distinct(F.transform(seen, urls.loose_form))).alias("target")).distinct()
    return as_findings(locs.join(known, ["crawl_id", "target"], "left_anti"), 91, url="loc")


def parameter_order_changes(crawl: DataFrame) -> DataFrame:
    """19: the same filter parameters in another order than the URL before."""
    raw = urls.param_names_raw("url")
    pages = crawl.where(F.col("url").contains("=")).select(
        "crawl_id", "seq", "url", F.array_join(raw, "\x00").alias("order"),
        F.array_sort(F.array_intersect(urls.param_names("url"), urls.literals(K.FILTER_PARAMS))).alias("family"),
    ).where(F.size("family") >= 2)
    seen = previous_in_group(pages, ["crawl_id", "family"], "seq", "order", "before")
    return as_findings(seen.where("before <> order"), 19)


def parameter_variants(crawl: DataFrame) -> DataFrame:
    """70: several URLs with a query share one base; listed base by base."""
    pages = crawl.where(urls.query("url") != "").select(
        "crawl_id", "seq", "url", urls.loose_form(urls.without_query("url")).alias("base"))
    shared = pages.groupBy("crawl_id", "base").agg(
        F.count("*").alias("n"), F.min("seq").alias("first")).where("n > 1")
    return as_findings(pages.join(shared, ["crawl_id", "base"]), 70, rank="first")


def pagination_explosion(crawl: DataFrame) -> DataFrame:
    """84: a base path with many paged variants."""
    pages = crawl.where(urls.has_param("url", K.PAGINATION_PARAMS)).select(
        "crawl_id", "seq", urls.without_query("url").alias("base"))
    bases = pages.groupBy("crawl_id", "base").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return as_findings(bases.where(F.col("n") > K.PAGINATION_VARIANT_LIMIT), 84, url="base")

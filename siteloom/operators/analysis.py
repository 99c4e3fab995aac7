"""Crawl summaries and link, redirect and image analyses, all per crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import urls
from siteloom.functions import constants as K
from siteloom.operators import hosts as H
from siteloom.operators.groups import top_n


# ---- summary ---------------------------------------------------------------
def count_key(df: DataFrame, column: str) -> Column:
    """Text key of a counted value: whole numbers without decimals, 'null' for null and NaN."""
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
        text = F.when(F.isnan(c), None).when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def value_counts(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Counts per value, ascending by the text key."""
    keys = list(by or [])
    counts = df.groupBy(*keys, count_key(df, column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(*keys, "value")


#: Row that holds what is left of a cut list of values.
REST = "(other)"


def content_types(crawl: DataFrame, n: int = K.TOP_CONTENT_TYPES) -> DataFrame:
    """The ``n`` most frequent content types, cut first and normalised at ';' afterwards, and one row for the rest."""
    kinds = F.coalesce(F.try_element_at(F.col("resp_headers"), F.lit("content-type")), F.lit("null"))
    counts = crawl.groupBy("crawl_id", kinds.alias("value")).agg(F.count("*").alias("n"))
    top = top_n(counts, ["crawl_id"], [F.desc("n"), F.col("value")], n)
    rest = counts.join(top.select("crawl_id", "value"), ["crawl_id", "value"], "left_anti").withColumn("value", F.lit(REST))
    name = F.trim(F.substring_index("value", ";", 1))
    return top.unionByName(rest).groupBy("crawl_id", name.alias("content_type")).agg(F.sum("n").alias("n"))


def crawl_summary(crawl: DataFrame) -> DataFrame:
    """(crawl_id, section, value, n): rows, column names, status, depth and content types.

    Every statistic is a small group count: one expanded aggregate covers them, a second scan
    counts the content types, which are cut afterwards.
    """
    entries = F.array(
        F.struct(F.lit("rows").alias("section"), F.lit("").alias("value")),
        F.struct(F.lit("status").alias("section"), count_key(crawl, "status").alias("value")),
        F.struct(F.lit("depth").alias("section"), count_key(crawl, "depth").alias("value")),
    )
    counted = crawl.select("crawl_id", F.inline(entries)).groupBy("crawl_id", "section", "value").agg(
        F.count("*").alias("n"))
    crawls = counted.where("section = 'rows'").select("crawl_id")
    columns = crawls.select("crawl_id", F.lit("columns").alias("section"), F.lit("").alias("value"),
                            F.lit(len(crawl.columns)).cast("bigint").alias("n"))
    types = content_types(crawl).select(
        "crawl_id", F.lit("content_type").alias("section"), F.col("content_type").alias("value"), "n")
    return counted.unionByName(columns).unionByName(types)


# ---- links -------------------------------------------------------------------
def link_facts(crawl: DataFrame) -> DataFrame:
    """One row per link: crawl_id, seq, url, pos, link, text, nofollow, host, page_host."""
    return crawl.select(
        "crawl_id", "seq", "url", urls.host("url").alias("page_host"),
        F.posexplode("links").alias("pos", "l"),
    ).select("crawl_id", "seq", "url", "pos", F.col("l.url").alias("link"), F.col("l.text").alias("text"),
             F.coalesce("l.nofollow", F.lit(False)).alias("nofollow"),
             urls.host("l.url").alias("host"), "page_host")


def _target_counts(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links summed per target before anything is joined, each flagged internal or not."""
    targets = links.groupBy("crawl_id", "link").agg(
        F.count("*").alias("n"), F.count_if("nofollow").alias("nofollow"),
        F.first("host").alias("host"), F.max(F.col("host") == F.col("page_host")).alias("same"))
    # Targets on their own site need no lookup; scattered keys keep them out of one partition.
    key = F.when(F.col("same"), F.concat(F.lit("//"), F.pmod(F.xxhash64("link"), F.lit(4096)))).otherwise(F.col("host"))
    known = hosts.select("crawl_id", F.col("host").alias("_key"), F.lit(True).alias("_known"))
    return targets.withColumn("_key", key).join(known, ["crawl_id", "_key"], "left").select(
        "crawl_id", "link", "n", "nofollow",
        (F.col("same") | F.coalesce("_known", F.lit(False))).alias("internal"))


def link_analysis(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Totals per crawl: all, internal, external, nofollow links and distinct internal targets."""
    inside = F.col("internal")
    return _target_counts(links, hosts).groupBy("crawl_id").agg(
        F.sum("n").alias("total_links"),
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("internal_links"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("external_links"),
        F.sum("nofollow").alias("nofollow_links"),
        F.count_if(inside).alias("unique_internal_targets"))


def top_targets(links: DataFrame, hosts: DataFrame, n: int = K.TOP_TARGETS) -> DataFrame:
    """Most linked internal targets per crawl."""
    inside = _target_counts(links, hosts).where("internal").select("crawl_id", "link", "n")
    return top_n(inside, ["crawl_id"], [F.desc("n"), F.col("link")], n)


def internal_links(links: DataFrame, hosts: DataFrame) -> DataFrame:
    return H.keep_internal(links, hosts, "host", "page_host")


def inlinks(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(crawl_id, target, inlinks, unique_inlinks) by strict normal form.

    Counted per target and source first: a page linked from everywhere is
    spread over its sources before its totals are added up.
    """
    per_source = (
        internal_links(links.select("crawl_id", "url", "link", "host", "page_host"), hosts)
        .groupBy("crawl_id", urls.strict_form("link").alias("target"), "url").agg(F.count("*").alias("n"))
    )
    return per_source.groupBy("crawl_id", "target").agg(
        F.sum("n").alias("inlinks"), F.count("*").alias("unique_inlinks"))


# ---- redirects -----------------------------------------------------------------
def redirect_facts(crawl: DataFrame) -> DataFrame:
    """One row per hop, the page itself included as the first and its final status on every row."""
    return crawl.where(F.size("redirects") > 0).select(
        "crawl_id", "seq", "url", "status", "download_latency", F.posexplode("redirects").alias("pos", "r"),
        F.size("redirects").alias("hops"),
    ).select("crawl_id", "seq", "url", "status", "download_latency", "pos", "hops",
             F.col("r.url").alias("hop"), F.col("r.reason").alias("type"))


def redirect_analysis(crawl: DataFrame) -> DataFrame:
    """(crawl_id, section, value, n): hops in all, by final status and by type."""
    rows = redirect_facts(crawl)
    entries = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("").alias("value")),
        F.struct(F.lit("status").alias("section"), count_key(rows, "status").alias("value")),
        F.struct(F.lit("type").alias("section"), F.coalesce("type", F.lit("null")).alias("value")))
    return rows.select("crawl_id", F.inline(entries)).groupBy("crawl_id", "section", "value").agg(
        F.count("*").alias("n"))


# ---- images ----------------------------------------------------------------------
def image_facts(crawl: DataFrame) -> DataFrame:
    """One row per image with a source."""
    return crawl.select("crawl_id", "seq", "url", F.posexplode("images").alias("pos", "i")).select(
        "crawl_id", "seq", "url", "pos", F.col("i.src").alias("src"), F.col("i.alt").alias("alt"),
    ).where("src IS NOT NULL")


def image_analysis(images: DataFrame) -> DataFrame:
    """Totals per crawl: images, distinct sources, images without alt text."""
    blank = F.trim(F.coalesce("alt", F.lit(""))) == ""
    per_src = images.groupBy("crawl_id", "src").agg(
        F.count("*").alias("n"), F.count_if(blank).alias("blank"))
    return per_src.groupBy("crawl_id").agg(
        F.sum("n").alias("total_images"), F.count("*").alias("unique_images"),
        F.sum("blank").alias("images_missing_alt"))


def image_extensions(images: DataFrame, n: int = K.TOP_EXTENSIONS) -> DataFrame:
    """Most frequent file suffixes per crawl."""
    counts = images.groupBy("crawl_id", urls.path_suffix("src").alias("extension")).agg(F.count("*").alias("n"))
    return top_n(counts, ["crawl_id"], [F.desc("n"), F.col("extension")], n)

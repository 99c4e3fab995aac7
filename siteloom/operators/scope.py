"""Which URLs belong to a crawl: allow-list, patterns, parameters, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteloom.functions import cells, urls
from siteloom.functions import constants as K
from siteloom.operators.groups import top_n


def host_allowed(df: DataFrame, allowed: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is an allowed domain or below one; all rows if none is given.

    ``allowed`` has one column ``domain``. Every host is turned into its own
    suffixes, so the test is an equality join however long the list is.
    """
    domains = allowed.select(F.lower("domain").alias("_suffix")).distinct()
    if domains.isEmpty():
        return df
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select(urls.host(url).alias("_host")).distinct()
    named = hosts.select("_host", F.explode(suffixes).alias("_suffix"))
    good = named.join(domains, "_suffix", "left_semi").select("_host").distinct()
    return df.withColumn("_host", urls.host(url)).join(good, "_host", "left_semi").drop("_host")


def crawl_scope(
    df: DataFrame, url: str = "url", allowed_domains: list[str] | None = None,
    include_url_regex: str | None = None, exclude_url_regex: str | None = None,
    include_url_params: list[str] | None = None, exclude_url_params: list[str] | None = None,
) -> DataFrame:
    """The URL filters of a crawl job, each optional."""
    keep = F.lit(True)
    if allowed_domains:
        host = F.regexp_replace(urls.host(url), r":\d+$", "")
        inside = F.lit(False)
        for d in allowed_domains:
            inside = inside | (host == d.lower()) | host.endswith("." + d.lower())
        keep = keep & inside
    if include_url_regex:
        keep = keep & F.col(url).rlike(include_url_regex)
    if exclude_url_regex:
        keep = keep & ~F.col(url).rlike(exclude_url_regex)
    names = urls.param_names_raw(url)
    if include_url_params:
        keep = keep & F.arrays_overlap(names, urls.literals(include_url_params))
    if exclude_url_params:
        keep = keep & ~F.arrays_overlap(names, urls.literals(exclude_url_params))
    return df.where(keep)


def image_scope(images: DataFrame, min_width: int = 0, min_height: int = 0,
                include_img_regex: str | None = None) -> DataFrame:
    """Image rows large enough and, if given, with a matching source."""
    kept = images.where((F.col("width") >= min_width) & (F.col("height") >= min_height))
    return kept.where(F.col("img_src").rlike(include_img_regex)) if include_img_regex else kept


def shallow_sample(crawl: DataFrame, n: int = K.LAB_SAMPLE) -> DataFrame:
    """Up to ``n`` distinct HTML pages with status 200 per crawl, shallowest first."""
    pages = crawl.where((F.col("status") == 200) & cells.is_html("resp_headers"))
    depth = F.coalesce("depth", F.lit(K.UNKNOWN_DEPTH))
    firsts = pages.groupBy("crawl_id", "url").agg(F.min(F.struct(depth.alias("depth"), "seq")).alias("at"))
    rows = firsts.select("crawl_id", "url", "at.depth", "at.seq")
    return top_n(rows, ["crawl_id"], [F.col("depth"), F.col("seq")], n, rank="place")

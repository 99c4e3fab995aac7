"""The crawl detail report: one flat row per fetched URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import cells, urls
from siteloom.functions import constants as K
from siteloom.operators import analysis, hosts as H


def _size(items: str | Column) -> Column:
    return F.size(items).cast("bigint")


def _length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def _with_canonical(crawl: DataFrame) -> DataFrame:
    """Adds ``is_self``: the canonical, made absolute, names the page itself."""
    absolute = crawl.withColumn("canonical_abs", F.when(F.col("canonical") != "", urls.resolve("url", "canonical")))
    same = urls.strict_form("canonical_abs") == urls.strict_form("url")
    return absolute.withColumn("is_self", F.col("canonical_abs").isNotNull() & same).drop("canonical_abs")


def _flat_columns() -> dict[str, Column]:
    url, status = F.col("url"), F.col("status")
    title, desc = cells.clean("title"), cells.clean("meta_desc")
    head = lambda name: F.coalesce(cells.header("resp_headers", name), F.lit(""))
    has_canonical = F.coalesce(F.col("canonical") != "", F.lit(False))
    self_canonical = F.col("is_self")
    robots = F.lower(cells.clean("meta_robots"))
    reason = (
        F.when(status.isNull(), "No response")
        .when(status >= 400, F.concat(F.lit("Non-200 ("), status, F.lit(")")))
        .when((status >= 300) & (status < 400), "Redirect")
        .when(robots.contains("noindex"), "Noindex")
        .when(has_canonical & ~self_canonical, "Canonicalised")
        .otherwise("")
    )
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    text_len = F.length(cells.clean("body_text"))
    missing_alt = F.filter("images", lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")
    last = F.try_element_at("redirects", F.lit(-1))
    type_keys = F.filter(F.array_sort(F.map_keys("jsonld")), lambda k: F.lower(k).endswith("@type"))
    types = F.array_distinct(F.filter(
        F.flatten(F.transform(type_keys, lambda k: cells.split_list(F.try_element_at(F.col("jsonld"), k)))),
        lambda t: t != ""))
    return {
        "Address": url,
        "Status Code": status.cast("bigint"),
        "Status": cells.status_phrase("status"),
        "Indexability": F.when(reason == "", "Indexable").otherwise("Non-Indexable"),
        "Indexability Reason": reason,
        "Content-Type": head("content-type"),
        "Content-Encoding": head("content-encoding"),
        "Response Time": cells.to_float("download_latency"),
        "Size (bytes)": size,
        "Crawl Depth": F.col("depth").cast("bigint"),
        "Crawl Timestamp": cells.clean("crawl_time"),
        "Language": cells.clean("html_lang"),
        "Title 1": title,
        "Title 1 Length": _length(title),
        "Meta Description 1": desc,
        "Meta Description 1 Length": _length(desc),
        "Meta Keywords 1": cells.clean("meta_keywords"),
        "H1-1": cells.at("h1", 0),
        "H1-1 Length": _length(cells.at("h1", 0)),
        "H1-2": cells.at("h1", 1),
        "H1 Count": _size("h1"),
        "H2-1": cells.at("h2", 0),
        "H2-2": cells.at("h2", 1),
        "H2 Count": _size("h2"),
        "Meta Robots 1": cells.clean("meta_robots"),
        "X-Robots-Tag 1": head("x-robots-tag"),
        "Meta Refresh 1": cells.clean("meta_refresh"),
        "Canonical Link Element 1": cells.clean("canonical"),
        "Canonical Is Self": self_canonical,
        "rel=next": cells.clean("rel_next"),
        "rel=prev": cells.clean("rel_prev"),
        "amphtml Link Element": cells.clean("amphtml"),
        "Word Count": cells.word_count("body_text"),
        "Text Ratio": F.when(size == 0, 0.0).otherwise(F.round(F.lit(100.0) * text_len / size, 1)),
        "Outlinks": _size("links"),
        "Unique Outlinks": _size(F.array_distinct(F.transform("links", lambda k: k["url"]))),
        "Images": _size("images"),
        "Images Missing Alt Text": _size(missing_alt),
        "Hreflang 1": F.coalesce(F.get("hreflang", F.lit(0))["lang"], F.lit("")),
        "Hreflang Count": _size("hreflang"),
        "Redirect URL": F.coalesce(last["url"], F.lit("")),
        "Redirect Type": F.coalesce(last["reason"], F.lit("")),
        "Last-Modified": head("last-modified"),
        "Server": head("server"),
        "IP Address": cells.clean("ip_address"),
        "Cookies": F.when(head("set-cookie") != "", "Yes").otherwise("No"),
        "Structured Data Types": F.array_join(types, "|"),
        "Structured Data Count": _size(types),
        "URL Length": _length(F.coalesce(url, F.lit(""))),
        "URL Encoded Address": F.coalesce(urls.percent_encode("url"), F.lit("")),
    }


def external_outlinks(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(crawl_id, seq, external, unique_external): links to named hosts the crawl never fetched.

    Only cross-host links are looked up, as distinct (page, link) pairs.
    """
    cross = links.where("host <> '' AND host <> page_host").groupBy("crawl_id", "seq", "host", "link").agg(
        F.count("*").alias("n"))
    outside = cross.join(hosts.select("crawl_id", "host"), ["crawl_id", "host"], "left_anti")
    return outside.groupBy("crawl_id", "seq").agg(
        F.sum("n").alias("external"), F.count("*").alias("unique_external"))


def crawl_detail(crawl: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """The 54 report columns, plus crawl_id and seq.

    Page text is reduced to counts before any shuffle; link metrics are joined
    on narrow keys and meet the wide rows once.
    """
    hosts = H.hosts_table(crawl) if hosts is None else hosts
    links = analysis.link_facts(crawl)
    keyed = crawl.select("crawl_id", "seq", urls.strict_form("url").alias("target"))
    metrics = keyed.join(analysis.inlinks(links, hosts), ["crawl_id", "target"], "left").drop("target").join(
        external_outlinks(links, hosts), ["crawl_id", "seq"], "left")
    flat = _with_canonical(crawl).select("crawl_id", "seq", *[c.alias(n) for n, c in _flat_columns().items()])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    full = flat.join(metrics, ["crawl_id", "seq"], "left").withColumns({
        "Inlinks": zero("inlinks"), "Unique Inlinks": zero("unique_inlinks"),
        "External Outlinks": zero("external"), "Unique External Outlinks": zero("unique_external")})
    return full.select("crawl_id", "seq", *[F.col(f"`{c}`") for c in K.DETAIL_COLUMNS])


def detail_totals(report: DataFrame) -> DataFrame:
    """Rows, columns, indexable and non-indexable URLs per crawl."""
    good = F.count_if(F.col("Indexability") == "Indexable")
    return report.groupBy("crawl_id").agg(
        F.count("*").alias("rows"), F.lit(len(K.DETAIL_COLUMNS)).cast("bigint").alias("column_count"),
        good.alias("indexable_urls"), (F.count("*") - good).alias("non_indexable_urls"))

"""Sitemap documents to URL rows, index expansion and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions.references import decoded_all
from siteloom.session import materialise
from siteloom.sources.robots import sitemap_lines

# ---- fixed values: elements read from a url entry -------------------------
_FIELDS = {
    "loc": "loc", "lastmod": "lastmod", "changefreq": "changefreq", "priority": "priority",
    "news_title": "news:title", "news_publication_date": "news:publication_date",
    "video_title": "video:title", "video_content_loc": "video:content_loc", "image_loc": "image:loc",
}


def _child(entry: Column, name: str) -> Column:
    """Content of a child element with its character references as they stand."""
    pattern = rf"(?is)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}\s*>"
    return F.when(entry.rlike(pattern), F.regexp_extract(entry, pattern, 1))


def _children(entry: Column, names) -> Column:
    """Contents of several child elements. An unclosed name in an address is a parameter."""
    return decoded_all(F.array(*[_child(entry, n) for n in names]), in_attribute=True)


def _entries(name: str) -> Column:
    body = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(body, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """docs(url, body, …) to one row per url entry, with the place it was found.

    A document that is neither a URL set nor an index yields one row that only
    carries ``errors``.
    """
    keys = [c for c in docs.columns if c not in ("url", "body")]
    known = F.col("body").rlike(r"(?i)<(urlset|sitemapindex)\b")
    rows = docs.select(*keys, F.col("url").alias("sitemap"), F.posexplode(_entries("url")).alias("pos", "entry"))
    parsed = rows.withColumn("_found", _children(F.col("entry"), _FIELDS.values())).select(
        *keys, "sitemap", "pos", *[F.get("_found", F.lit(i)).alias(n) for i, n in enumerate(_FIELDS)],
        F.lit(None).cast("string").alias("errors"))
    broken = docs.where(~F.coalesce(known, F.lit(False))).select(
        *keys, F.col("url").alias("sitemap"), F.lit(0).alias("pos"),
        *[F.lit(None).cast("string").alias(n) for n in _FIELDS], F.lit("not a sitemap document").alias("errors"))
    return parsed.unionByName(broken)


def rejected_documents(docs: DataFrame) -> DataFrame:
    """What docs(url, body, …) hold that gives no address: the other columns, sitemap, place, raw, reason.

    A document that is no sitemap, or whose end was cut off, is one row with the place null. An entry without an
    address is one row with its place (from 0) and text. A cut document still gives the addresses of its whole entries.
    """
    keys = [c for c in docs.columns if c not in ("url", "body")]
    body = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    opened = F.lower(F.regexp_extract(body, r"(?i)<(urlset|sitemapindex)\b", 1))
    reason = (
        F.when(F.col("body").isNull(), "no body").when(opened == "", "not a sitemap document")
        .when(~F.contains(F.lower(body), F.concat(F.lit("</"), opened)) & ~F.rlike(body, F.lit(r"(?i)<(?:urlset|sitemapindex)\b[^>]*/>")), "cut document"))
    whole = F.when(reason.isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("place"), F.col("body").alias("raw"), reason.alias("reason"))))
    entries = F.concat(_entries("url"), _entries("sitemap"))
    bare = F.filter(F.transform(entries, lambda e, i: F.struct(i.alias("place"), e.alias("raw"), F.lit("entry without an address").alias("reason"))),
                    lambda x: F.coalesce(F.trim(_child(x["raw"], "loc")) == "", F.lit(True)))
    none = F.array().cast("array<struct<place:int,raw:string,reason:string>>")
    found = F.concat(F.coalesce(whole, none), F.when(opened != "", bare).otherwise(none))
    return docs.select(*keys, F.col("url").alias("sitemap"), F.inline(found))


def index_children(docs: DataFrame) -> DataFrame:
    """(sitemap, child): addresses listed by index documents."""
    rows = docs.select(F.col("url").alias("sitemap"), F.explode(_entries("sitemap")).alias("entry"))
    return rows.select("sitemap", F.get(_children(F.col("entry"), ["loc"]), F.lit(0)).alias("child")).where("child IS NOT NULL")


def expand(start: DataFrame, docs: DataFrame, recursive: bool = True) -> DataFrame:
    """URL rows of the documents in ``start(url)`` and, if asked, of all they list."""
    roots = start.select(F.col("url").alias("root")).distinct()
    reached = listed_documents(roots, docs) if recursive else roots.select("root", F.col("root").alias("url"))
    return sitemap_urls(docs.join(reached.select("url").distinct(), "url", "left_semi"))


def listed_documents(roots: DataFrame, docs: DataFrame) -> DataFrame:
    """(root, url): every document an index of ``roots(root)`` leads to, itself included.

    One join per index level until a level brings nothing new, however deep; documents that list
    each other are met once. Each level is written down, so a lost executor never replays the levels before.
    """
    level = materialise(roots.select("root", F.col("root").alias("url")).distinct(), "sitemaps-0")
    reached = level
    children = materialise(index_children(docs).distinct(), "sitemap-index")
    while not level.isEmpty():
        fresh = level.join(children, F.col("url") == F.col("sitemap")).select("root", F.col("child").alias("url"))
        level = materialise(fresh.distinct().join(reached, ["root", "url"], "left_anti"), "sitemaps")
        reached = reached.unionByName(level)
    return reached


def discover(robots: DataFrame, primaries: DataFrame, docs: DataFrame) -> DataFrame:
    """(crawl_id, sitemap): Sitemap lines in order, then /sitemap.xml; the first that leads to rows wins.

    An index leads to the rows of the documents below it.
    """
    lines = sitemap_lines(robots).select("crawl_id", F.col("pos").alias("rank"), F.col("loc").alias("url"))
    scheme = F.when(F.col("primary_host").contains(":"), "http://").otherwise("https://")
    usual = primaries.where("primary_host <> ''").select(
        "crawl_id", F.lit(2 ** 31 - 1).alias("rank"),
        F.concat(scheme, F.col("primary_host"), F.lit("/sitemap.xml")).alias("url"))
    candidates = materialise(lines.unionByName(usual), "sitemap-candidates")
    filled = docs.where(F.size(_entries("url")) > 0).select("url").distinct()
    below = listed_documents(candidates.select(F.col("url").alias("root")).distinct(), docs)
    good = candidates.join(below.join(filled, "url", "left_semi").select(F.col("root").alias("url")).distinct(), "url", "left_semi")
    return good.groupBy("crawl_id").agg(F.min_by("url", "rank").alias("sitemap"))

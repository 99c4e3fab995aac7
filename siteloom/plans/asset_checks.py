"""Checks on scripts, styles and images, joined to supplied asset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteloom.functions import urls
from siteloom.functions import constants as K
from siteloom.plans.graph_checks import as_findings, union_all
from siteloom.sources.robots import blocked_by, rule_arrays, sitemap_lines

_STATUS_CHECKS, _BODY_CHECKS = (13, 41, 45), (42, 43, 46, 54)


def page_assets(crawl: DataFrame) -> DataFrame:
    """(crawl_id, url, script, style, image): distinct assets with the place each list first names them."""
    def tagged(items, kind: int):
        return F.transform(items, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), x.alias("asset")))

    lists = F.concat(
        tagged(F.col("script_src"), 0), tagged(F.col("stylesheet_href"), 1),
        tagged(F.transform("images", lambda x: x["src"]), 2))
    rows = crawl.select("crawl_id", "seq", F.inline(lists)).where("asset <> '' AND lower(asset) <> 'nan'")

    def first(kind: int):
        return F.min(F.when(F.col("kind") == kind, F.struct("seq", "pos")))

    return rows.groupBy("crawl_id", F.col("asset").alias("url")).agg(
        first(0).alias("script"), first(1).alias("style"), first(2).alias("image"))


def check_assets(assets: DataFrame) -> DataFrame:
    """Assets paired with every check that looks at them, in first-seen order."""
    def place(rank: int, col: str):
        return F.struct(F.lit(rank).cast("bigint").alias("rank"), F.col(f"{col}.seq"), F.col(f"{col}.pos"))

    def seen(*cols: str):
        return F.coalesce(*[F.when(F.col(c).isNotNull(), place(i, c)) for i, c in enumerate(cols)])

    wanted = {
        13: seen("script", "style"), 14: seen("script", "style"), 41: seen("image"), 80: seen("image"),
        42: F.when(urls.has_suffix("url", (".js",)), seen("script")),
        43: F.when(urls.has_suffix("url", (".css",)), seen("style")),
        45: seen("script", "style", "image"), 46: seen("script"), 54: seen("style"),
    }
    uses = F.array_compact(F.array(*[
        F.when(at.isNotNull(), F.struct(F.lit(n).alias("num"), at.alias("at"))) for n, at in wanted.items()]))
    return assets.select("crawl_id", "url", F.inline(uses)).select(
        "crawl_id", "url", "num", "at.rank", "at.seq", "at.pos")


def robots_blocked(uses: DataFrame, robots: DataFrame) -> DataFrame:
    """14 and 80: assets a disallow rule matches; every asset is tested."""
    tested = uses.where("num IN (14, 80)").join(rule_arrays(robots), "crawl_id")
    hit = tested.where(blocked_by(F.col("rules"), urls.path("url")))
    return as_findings(hit, F.col("num"), rank="rank", pos="pos")


def one_status(statuses: DataFrame) -> DataFrame:
    """(crawl_id, url, status): of several statuses of an address the highest."""
    return statuses.groupBy("crawl_id", "url").agg(F.max("status").alias("status"))


def one_body(bodies: DataFrame) -> DataFrame:
    """(crawl_id, url, body): of several bodies of an address the last in text order."""
    return bodies.groupBy("crawl_id", "url").agg(F.max("body").alias("body"))


def looked_up(uses: DataFrame, statuses: DataFrame, bodies: DataFrame) -> DataFrame:
    """All assets of each check with what is known about them."""
    chosen = uses.where(F.col("num").isin(*_STATUS_CHECKS, *_BODY_CHECKS))
    joined = chosen.join(one_status(statuses), ["crawl_id", "url"], "left").join(one_body(bodies), ["crawl_id", "url"], "left")
    by_status = F.col("num").isin(*_STATUS_CHECKS)
    return joined.withColumn("resolved", F.when(by_status, F.col("status").isNotNull()).otherwise(
        F.col("body").isNotNull()))


def asset_findings(known: DataFrame) -> DataFrame:
    """13, 41, 42, 43, 46, 54 on what was resolved. 45 has no offending state."""
    broken = F.col("num").isin(13, 41) & (F.col("status") >= 400)
    breaks = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))
    verbose = F.col("num").isin(42, 43) & (F.length("body") > 0) & (
        breaks / F.length("body") > K.NEWLINE_RATIO_LIMIT)
    writes = (F.col("num") == 46) & F.col("body").contains("document.write")
    imports = (F.col("num") == 54) & F.col("body").contains("@import")
    return as_findings(known.where(broken | verbose | writes | imports), F.col("num"), rank="rank", pos="pos")


def robots_sitemaps(robots: DataFrame, statuses: DataFrame) -> DataFrame:
    """39: the addresses of Sitemap lines with their status."""
    lines = sitemap_lines(robots).groupBy("crawl_id", F.col("loc").alias("url")).agg(F.min("pos").alias("pos"))
    chosen = lines.select(
        "crawl_id", "url", F.lit(39).alias("num"), F.lit(0).cast("bigint").alias("rank"),
        F.lit(0).cast("bigint").alias("seq"), "pos")
    return _with_status(chosen, statuses)


def host_variants(primaries: DataFrame, statuses: DataFrame) -> DataFrame:
    """82: the insecure and the www / bare variant of the primary host with their status."""
    p = F.col("primary_host")
    other = F.when(p.startswith("www."), F.concat(F.lit("https://"), F.substr(p, F.lit(5)), F.lit("/"))).otherwise(
        F.concat(F.lit("https://www."), p, F.lit("/")))
    variants = F.array(F.concat(F.lit("http://"), p, F.lit("/")), other)
    chosen = primaries.where("primary_host <> ''").select(
        "crawl_id", F.posexplode(variants).alias("pos", "url"), F.lit(82).alias("num"),
        F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("seq"))
    return _with_status(chosen, statuses)


def _with_status(chosen: DataFrame, statuses: DataFrame) -> DataFrame:
    joined = chosen.join(one_status(statuses), ["crawl_id", "url"], "left")
    return joined.withColumn("resolved", F.col("status").isNotNull())


def status_findings(known: DataFrame) -> DataFrame:
    """39 on error statuses, 82 on variants that answer."""
    bad = ((F.col("num") == 39) & (F.col("status") >= 400)) | (
        (F.col("num") == 82) & (F.col("status") >= 200) & (F.col("status") < 300))
    return as_findings(known.where(bad), F.col("num"), rank="rank", pos="pos")


def onclick_tested(html: DataFrame) -> DataFrame:
    """81 on every row of html(crawl_id, seq, url, html)."""
    return html.select(
        "crawl_id", "url", F.lit(81).alias("num"), "seq",
        F.col("html").isNotNull().alias("resolved"), F.col("html").rlike(K.ONCLICK_ANCHOR).alias("bad"))


def onclick_pages(html: DataFrame) -> DataFrame:
    """81 on the first fetch of every page."""
    first = onclick_tested(html).groupBy("crawl_id", "url", "num").agg(
        F.min_by(F.struct("seq", "resolved", "bad"), "seq").alias("r"))
    return first.select("crawl_id", "url", "num", "r.*")


def onclick_findings(tested: DataFrame) -> DataFrame:
    return as_findings(tested.where("bad"), 81)


def scope(*known: DataFrame) -> DataFrame:
    """(crawl_id, num, chosen, resolved): how much there was to judge."""
    rows = union_all([d.select("crawl_id", "num", "resolved") for d in known])
    return rows.groupBy("crawl_id", "num").agg(
        F.count("*").alias("chosen"), F.count_if("resolved").alias("resolved"))

"""Checks decided by one page alone: one scan evaluates all their predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import cells, urls
from siteloom.functions import constants as K
from siteloom.plans.catalogue import CHECKS, Check, of_kind
from siteloom.session import materialise


def page_columns(crawl: DataFrame) -> DataFrame:
    """The crawl with the derived columns the predicates share."""
    return crawl.withColumns({
        "html200": cells.is_html("resp_headers") & F.coalesce(F.col("status") == 200, F.lit(False)),
        "has_canonical": F.coalesce(F.col("canonical") != "", F.lit(False)),
        "canonical_scheme": F.coalesce(urls.scheme("canonical"), F.lit("")),
        "canonical_host": F.coalesce(urls.host("canonical"), F.lit("")),
        "params": urls.param_names("url"),
        "robots_meta": F.coalesce(F.lower("meta_robots"), F.lit("")),
    })


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _text_length(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0))


def _has_family(family) -> Column:
    return F.coalesce(F.arrays_overlap("params", urls.literals(family)), F.lit(False))


def _param_not_canonical(family) -> Column:
    target = F.when(F.col("has_canonical"), urls.loose_form("canonical")).otherwise("")
    return _has_family(family) & (target != urls.loose_form(urls.without_query("url")))


def _followed_param_link(family) -> Column:
    # The cheap '=' test comes first: most links carry no parameter at all.
    return F.exists("links", lambda k: ~F.coalesce(k["nofollow"], F.lit(False))
                    & k["url"].contains("=") & urls.has_param(k["url"], family))


def _any_suffix(items: str, suffixes, field: str | None = None) -> Column:
    return F.exists(items, lambda x: F.coalesce(urls.has_suffix(x[field] if field else x, suffixes), F.lit(False)))


def _insecure(items: str, field: str | None = None) -> Column:
    return F.exists(items, lambda x: F.coalesce(
        F.lower(x[field] if field else x).startswith("http://"), F.lit(False)))


def markup_keys(crawl: DataFrame) -> DataFrame:
    """(crawl_id, _type_key, _context_key): the key that holds type and context in a whole crawl.

    The top-level key if any page has it, else the smallest key with that ending.
    """
    keys = crawl.select("crawl_id", F.explode(F.map_keys("jsonld")).alias("key"))

    def chosen(suffix: str) -> Column:
        ends = F.lower("key").endswith(suffix)
        return F.min(F.when(ends, F.struct(F.col("key") != suffix, "key")))["key"]

    return keys.groupBy("crawl_id").agg(chosen("@type").alias("_type_key"), chosen("@context").alias("_context_key"))


def _structured(key: str) -> Column:
    """Value under the crawl's key, null without one."""
    return F.try_element_at(F.col("jsonld"), F.col(key))


def _repeats(items: Column) -> Column:
    return F.size(items) != F.size(F.array_distinct(items))


def _malformed_canonical() -> Column:
    inner_blank = F.coalesce(F.trim("canonical").contains(" "), F.lit(False))
    return F.col("has_canonical") & (inner_blank | (F.col("canonical_scheme") == ""))


def _incomplete_viewport() -> Column:
    v = F.coalesce(F.lower("viewport"), F.lit(""))
    return ~(v.contains("width") & v.contains("initial-scale"))


def _no_markup_type() -> Column:
    return (F.size("jsonld") > 0) & (_structured("_type_key").isNull() | _structured("_context_key").isNull())


def _malformed_url() -> Column:
    u = F.coalesce(F.col("url"), F.lit(""))
    return ~urls.has_scheme(u) | (urls.netloc(u) == "") | u.contains(" ") | u.rlike(r"[\x00-\x1f]")


def _compressed() -> Column:
    return F.coalesce(F.lower(cells.header("resp_headers", "content-encoding")).rlike(K.COMPRESSED), F.lit(False))


#: Checks that read nothing of a page but its address and its links, scripts, styles and images.
OF_LISTS = frozenset({18, 20, 29, 47, 49, 53, 64, 65, 85, 89})


def predicates() -> dict[int, Column]:
    """Check number to the predicate an offending page satisfies."""
    status = F.col("status")
    html200 = F.col("html200")
    return {
        1: html200 & (_text_length("body_text") < K.EMPTY_BODY_CHARS)
           & cells.header("resp_headers", "set-cookie").isNotNull(),
        2: status.isin(*K.BLOCKED_STATUSES),
        7: _count("canonical_total_count") > _count("canonical_in_head_count"),
        8: urls.netloc("canonical").rlike(K.STAGING_HOST),
        10: _param_not_canonical(K.FILTER_PARAMS),
        11: _param_not_canonical(K.SORT_PARAMS),
        12: _malformed_canonical() | (_count("canonical_total_count") > 1),
        17: _has_family(K.PAGINATION_PARAMS),
        18: F.exists("links", lambda k: F.lower(k["url"]).contains("utm_")),
        20: F.exists("links", lambda k: k["url"].rlike(K.SEARCH_PATH)),
        23: _count("head_count") > 1,
        28: (F.size("head_script_src") > 0) | (F.size("head_stylesheet_href") > 0),
        29: _any_suffix("images", K.LEGACY_IMAGES, "src"),
        30: _no_markup_type(),
        33: _count("title_count") > _count("title_in_head_count"),
        34: html200 & (F.trim(F.array_join("h1", K.LIST_DELIMITER)) == ""),
        40: F.col("has_canonical") & (F.col("canonical_scheme") == ""),
        44: html200 & ~_compressed(),
        47: F.exists("stylesheet_href", lambda s: F.lower(s).rlike(
            "(" + "|".join(x.replace(".", "[.]") for x in K.LEGACY_FONTS) + ")$")),
        48: (status >= 500) & (status < 600),
        49: F.lower("url").startswith("https://") & (
            _insecure("script_src") | _insecure("stylesheet_href")
            | _insecure("images", "src") | _insecure("links", "url")),
        50: _malformed_url(),
        51: F.size("preconnect_href") > 0,
        52: html200 & _incomplete_viewport(),
        53: _any_suffix("images", (".gif",), "src"),
        55: F.col("meta_desc").rlike(K.MARKUP_IN_TEXT),
        56: _count("meta_desc_total_count") > 1,
        59: (F.size("redirects") > 0) & (status >= 400),
        60: _repeats(F.transform(
            F.concat(F.array("url"), F.transform("redirects", lambda r: r["url"])), urls.loose_form)),
        61: F.col("robots_meta").contains("nosnippet"),
        62: F.col("robots_meta").contains("noarchive"),
        63: F.col("robots_meta").contains("noindex") & F.col("has_canonical"),
        64: _followed_param_link(K.FILTER_PARAMS),
        65: _followed_param_link(K.SORT_PARAMS),
        74: _count("meta_desc_total_count") > _count("meta_desc_in_head_count"),
        76: _count("title_count") > 1,
        79: html200 & (F.trim(F.coalesce("canonical", F.lit(""))) == ""),
        83: urls.has_suffix("url", (".json",)),
        85: (F.size("images") > 0) & ~_any_suffix("images", K.MODERN_IMAGES, "src"),
        89: _repeats(F.transform("script_src", urls.before_query)),
    }


def page_findings(crawl: DataFrame, nums: list[int] | None = None,
                  checks: dict[int, Check] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(crawl_id, num, basis, rank, seq, pos, url): one row per offending page and check.

    ``keys`` are the stored :func:`markup_keys`, one row per crawl, which check 30 needs.
    """
    checks = checks or CHECKS
    built_in = predicates()
    chosen = nums if nums is not None else of_kind("row", "list", "fallback", checks=checks)
    hits = [
        F.when(checks[n].predicate() if checks[n].predicate else built_in[n], F.lit(n))
        for n in chosen if checks[n].predicate or n in built_in
    ]
    static = [n for n in chosen if checks[n].kind == "fallback"]
    basis = F.when(F.col("num").isin(*static), "static").otherwise("crawl") if static else F.lit("crawl")
    pages = page_columns(crawl)
    if 30 in chosen:
        keys = materialise(markup_keys(crawl), "markup_keys") if keys is None else keys
        pages = pages.join(keys, "crawl_id", "left")
    return (
        pages
        .select("crawl_id", "seq", "url", F.explode(F.array_compact(F.array(*hits))).alias("num"))
        .select("crawl_id", "num", basis.alias("basis"), F.lit(0).cast("bigint").alias("rank"),
                "seq", F.lit(0).alias("pos"), "url")
    )

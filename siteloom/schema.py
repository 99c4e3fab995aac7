"""The crawl table: one row per fetched URL of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siteloom.functions import cells
from siteloom.functions.constants import JSONLD_PREFIX, RESP_HEADER_PREFIX

_S, _STRINGS = T.StringType(), T.ArrayType(T.StringType())

LINK = T.StructType([
    T.StructField("url", _S), T.StructField("text", _S), T.StructField("nofollow", T.BooleanType()),
])
IMAGE = T.StructType([T.StructField("src", _S), T.StructField("alt", _S)])
REDIRECT = T.StructType([
    T.StructField("url", _S), T.StructField("reason", _S), T.StructField("time", _S),
])
HREFLANG = T.StructType([T.StructField("lang", _S), T.StructField("href", _S)])

_TEXT = (
    "url", "title", "meta_desc", "meta_robots", "canonical", "body_text", "viewport", "crawl_time",
    "ip_address", "html_lang", "meta_keywords", "meta_refresh", "rel_next", "rel_prev", "amphtml",
)
_LISTS = (
    "h1", "h2", "title_all", "meta_desc_all", "canonical_all", "nav_links_url", "script_src",
    "stylesheet_href", "head_script_src", "head_stylesheet_href", "preconnect_href", "preload_href",
)
_COUNTS = (
    "head_count", "title_count", "title_in_head_count", "canonical_total_count",
    "canonical_in_head_count", "meta_desc_total_count", "meta_desc_in_head_count",
)

CRAWL = T.StructType(
    [T.StructField("crawl_id", _S), T.StructField("seq", T.LongType()),
     T.StructField("status", T.LongType()), T.StructField("size", T.LongType()),
     T.StructField("depth", T.LongType()), T.StructField("download_latency", T.DoubleType())]
    + [T.StructField(n, _S) for n in _TEXT]
    + [T.StructField(n, _STRINGS) for n in _LISTS]
    + [T.StructField(n, T.LongType()) for n in _COUNTS]
    + [T.StructField("links", T.ArrayType(LINK)), T.StructField("images", T.ArrayType(IMAGE)),
       T.StructField("redirects", T.ArrayType(REDIRECT)), T.StructField("hreflang", T.ArrayType(HREFLANG)),
       T.StructField("resp_headers", T.MapType(_S, _S)), T.StructField("jsonld", T.MapType(_S, _S))]
)

# Parallel list columns of the flat form, matched by position.
_ZIPPED = {
    "links": (LINK, {"url": "links_url", "text": "links_text", "nofollow": "links_nofollow"}),
    "images": (IMAGE, {"src": "img_src", "alt": "img_alt"}),
    "redirects": (REDIRECT, {"url": "redirect_urls", "reason": "redirect_reasons", "time": "redirect_times"}),
    "hreflang": (HREFLANG, {"lang": "hreflang_hreflang", "href": "hreflang_href"}),
}
_MAPS = {"resp_headers": (RESP_HEADER_PREFIX, True), "jsonld": (JSONLD_PREFIX, False)}


def _zip(df: DataFrame, struct: T.StructType, parts: dict[str, str]) -> Column:
    """The lead list decides the length; a short side reads as null."""
    names = list(parts)
    lists = {
        n: cells.split_list(F.col(c).cast("string")) if c in df.columns else F.array().cast(_STRINGS)
        for n, c in parts.items()
    }
    lead = lists[names[0]]

    def item(x: Column, i: Column) -> Column:
        fields = [x.alias(names[0])]
        for n in names[1:]:
            value = F.get(lists[n], i)
            if isinstance(struct[n].dataType, T.BooleanType):
                value = F.coalesce(F.lower(value) == "true", F.lit(False))
            fields.append(value.alias(n))
        return F.struct(*fields)

    return F.transform(lead, item)


def _gather(df: DataFrame, prefix: str, lower: bool) -> Column:
    """Column family to map: nulls and 'nan' dropped, first of equal names kept."""
    found: dict[str, Column] = {}
    for c in df.columns:
        if not c.lower().startswith(prefix):
            continue
        key = c[len(prefix):].lower() if lower else c[len(prefix):]
        value = cells.known(F.col(f"`{c}`").cast("string"))
        found[key] = F.coalesce(found[key], value) if key in found else value
    empty = F.create_map().cast(T.MapType(_S, _S))
    if not found:
        return empty
    pairs = [x for k, v in found.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def conform(df: DataFrame, crawl_id: str | None = None) -> DataFrame:
    """Bring a flat or typed crawl to the ``CRAWL`` schema; absent columns read as null.

    Flat list cells, header and structured-data column families are folded to
    arrays and maps. Columns the schema does not know (own selectors, ``og:`` fields, request headers)
    follow as they are, so slices and summaries reach them. Without a ``seq`` column rows are numbered
    in load order; readers of several files number them by file and place first.
    """
    have = dict(df.dtypes)
    out = []
    for field in CRAWL:
        name, kind = field.name, field.dataType
        if name == "crawl_id" and name not in have:
            value = F.lit(crawl_id if crawl_id is not None else "crawl")
        elif name == "seq" and name not in have:
            value = F.monotonically_increasing_id()
        elif name in _ZIPPED and have.get(name, "string") == "string":
            struct, parts = _ZIPPED[name]
            value = _zip(df, struct, parts)
        elif name in _MAPS and name not in have:
            value = _gather(df, *_MAPS[name])
        elif name not in have:
            value = F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.lit(None).cast(kind)
        elif isinstance(kind, T.ArrayType) and have[name] == "string":
            value = cells.split_list(name)
        elif isinstance(kind, T.LongType) and have[name] not in ("bigint", "int"):
            value = cells.to_int(name)
        elif isinstance(kind, T.DoubleType) and have[name] != "double":
            value = cells.to_double(name)
        elif isinstance(kind, T.StringType) and name not in ("crawl_id", "url"):
            value = cells.known(F.col(name).cast("string"))
        else:
            value = F.col(name)
        out.append(value.cast(kind).alias(name))
    folded = {c for _, parts in _ZIPPED.values() for c in parts.values()}
    prefixes = tuple(prefix for prefix, _ in _MAPS.values())
    others = [c for c in df.columns if c not in CRAWL.names and c not in folded and not c.lower().startswith(prefixes)]
    return df.select(*out, *[F.col(f"`{c}`") for c in others])


def with_lists(crawl: DataFrame, lists: DataFrame) -> DataFrame:
    """``crawl`` with the list columns of ``lists(crawl_id, url, ...)`` in place of its own, empty where an address has none."""
    names = [n for n in lists.columns if n not in ("crawl_id", "url")]
    renamed = lists.select("crawl_id", "url", *[F.col(n).alias(f"_{n}") for n in names])
    return crawl.join(renamed, ["crawl_id", "url"], "left").withColumns({
        n: F.coalesce(F.col(f"_{n}"), F.array().cast(CRAWL[n].dataType)) for n in names
    }).select(*[F.col(f"`{c}`") for c in crawl.columns])

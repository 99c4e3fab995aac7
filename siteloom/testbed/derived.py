"""Crawl inputs derived from the ``pages`` table, one row at a time.

The supplied pages carry no status, headers, canonical or image data, so those
are computed from ``page_id``. Every expression below is plain SQL that Spark
and DuckDB read alike; the Spark side builds list columns in the row itself,
so deriving the crawl is one narrow projection without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom import schema
from siteloom.session import new_path
from siteloom.sources.crawl import read_crawl, write_crawl

SHOP = "https://shop.example.com"

URL = f"""CASE page_id % 25
 WHEN 1 THEN '{SHOP}/list?color=red&size=' || CAST(page_id AS STRING)
 WHEN 2 THEN '{SHOP}/list?size=2&color=' || CAST(page_id AS STRING)
 WHEN 3 THEN '{SHOP}/list?sort=price'
 WHEN 4 THEN '{SHOP}/item/?sid=' || CAST(page_id AS STRING)
 WHEN 5 THEN '{SHOP}/search?q=' || CAST(page_id AS STRING)
 WHEN 6 THEN '{SHOP}/feed/' || CAST(page_id AS STRING) || '.json?v=1'
 WHEN 7 THEN 'broken url ' || CAST(page_id AS STRING)
 WHEN 8 THEN '{SHOP}/cat?page=' || CAST(page_id AS STRING)
 WHEN 9 THEN '{SHOP}/cat?page=' || CAST(page_id AS STRING)
 WHEN 10 THEN '{SHOP}/cat?page=' || CAST(page_id AS STRING)
 ELSE url END"""

# A nearby page of the same crawl whose URL is a function of its id.
PEER = f"""'{SHOP}/cat?page=' || CAST(page_id - page_id % 25
 + CASE page_id % 3 WHEN (page_id - page_id % 25 + 8) % 3 THEN 8
                    WHEN (page_id - page_id % 25 + 9) % 3 THEN 9 ELSE 10 END AS STRING)"""

# Step 1 over pages(page_id, url, html).
BASE = {
    "seq": "page_id",
    "crawl_id": "CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END",
    "url": URL,
    "peer": PEER,
    "html": "html",
}

# Step 2 over step 1; url is the derived one.
SCALARS = {
    "origin": "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)",
    "status": """CASE seq % 20 WHEN 8 THEN 404 WHEN 9 THEN 500 WHEN 10 THEN 403
                 WHEN 11 THEN 301 WHEN 12 THEN NULL ELSE 200 END""",
    "depth": "CASE WHEN seq % 17 = 0 THEN NULL ELSE CAST(seq % 6 AS BIGINT) END",
    "size": "CAST(length(html) AS BIGINT)",
    "download_latency": "CAST(seq % 100 AS DOUBLE) / 64",
    "crawl_time": "'2024-05-0' || CAST(1 + seq % 9 AS STRING) || ' 10:00:00'",
    "ip_address": "'10.0.0.' || CAST(seq % 250 AS STRING)",
    "content_type": """CASE WHEN seq % 13 = 0 THEN 'application/pdf' WHEN seq % 13 = 1 THEN NULL
                       ELSE 'text/html; charset=utf-8' END""",
    "content_encoding": "CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN 'gzip' ELSE 'br' END",
    "set_cookie": "CASE WHEN seq % 4 = 0 THEN 'a=1' END",
    "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "html_lang": "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)",
    "title_count": "CASE WHEN seq % 10 = 0 THEN 2 ELSE 1 END",
    "title_in_head_count": "1",
    "head_count": "CASE WHEN seq % 31 = 0 THEN 2 ELSE 1 END",
    "meta_desc": """CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Has <b>bold</b>'
                    ELSE 'Plain text' END""",
    "meta_desc_total_count": "CASE seq % 12 WHEN 0 THEN 2 ELSE 1 END",
    "meta_desc_in_head_count": "1",
    "meta_robots": """CASE seq % 7 WHEN 0 THEN 'NOINDEX,follow' WHEN 1 THEN 'nosnippet'
                      WHEN 2 THEN 'noarchive' WHEN 3 THEN NULL ELSE 'index,follow' END""",
    "h1_cell": """CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 11 = 1 THEN ' '
                  WHEN seq % 11 = 2 THEN 'First@@Second'
                  ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END""",
    "h2_cell": "CASE WHEN seq % 8 = 0 THEN 'x@@@@y' WHEN seq % 8 = 1 THEN 'nan' ELSE '' END",
    "canonical": f"""CASE seq % 9 WHEN 0 THEN NULL WHEN 2 THEN 'https://staging.example.com/x'
                    WHEN 3 THEN 'https://third.example.edu/' WHEN 4 THEN '/rel/../path'
                    WHEN 5 THEN 'https://bad host.example.com/'
                    WHEN 6 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/'
                    WHEN 7 THEN peer ELSE url END""",
    "canonical_total_count": "CASE WHEN seq % 14 = 0 THEN 2 ELSE 1 END",
    "canonical_in_head_count": "1",
    "body_text": """CASE WHEN seq % 16 = 0 THEN '' WHEN seq % 16 = 1 THEN 'short text'
                    ELSE regexp_extract(html, '<footer>(.*)</footer>', 1) END""",
    "viewport": """CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN 'width=device-width'
                   ELSE 'width=device-width, initial-scale=1' END""",
    "jsonld_type": "CASE seq % 6 WHEN 0 THEN 'NewsOrganization' WHEN 1 THEN 'Product' END",
    "jsonld_author_type": "CASE seq % 12 WHEN 0 THEN 'Person@@NewsOrganization' END",
    "jsonld_context": "CASE seq % 4 WHEN 0 THEN 'https://schema.org' END",
    "nav_cell": "CASE WHEN seq % 4 = 0 THEN '' ELSE regexp_extract(html, '<a href=\"([^\"]*)\"', 1) END",
    "preconnect": "CASE WHEN seq % 29 = 0 THEN 'https://cdn.example.com' END",
}

# Long-form lists: (pos, condition, values...). The same rows feed both engines.
LINKS = [
    (100, "TRUE", "peer", "seq % 2 = 0"),
    (101, "seq % 8 = 0", f"'{SHOP}/list?utm_source=nav&color=red'", "FALSE"),
    (102, "seq % 10 = 0", "origin || '/search?q=1'", "FALSE"),
    (103, "seq % 12 = 0", "'http://ext.example.edu/a?sort=asc'", "seq % 24 = 0"),
]
NAV_PATTERN = '<a href="([^"]*)"'
IMAGES = [
    (0, "seq % 3 = 0", "origin || '/img/' || CAST(seq AS STRING) || '.png'", "'logo'"),
    (1, "seq % 3 = 0", "origin || '/img/x.jpg'", "''"),
    (2, "seq % 5 = 0", "'https://cdn.example.com/a.webp'", "'a'"),
    (3, "seq % 7 = 0", "'https://cdn.example.com/b.GIF?v=1'", "CAST(NULL AS STRING)"),
    (4, "seq % 11 = 0", "'http://cdn.example.com/c.bmp'", "'c'"),
]
SCRIPTS = [
    (0, "seq % 2 = 0", "'https://cdn.example.com/app.js'", "seq % 4 = 0"),
    (1, "seq % 6 = 0", "'https://cdn.example.com/app.js?v=2'", "seq % 4 = 0"),
    (2, "seq % 9 = 0", "origin || '/assets/s' || CAST(seq AS STRING) || '.js'", "seq % 4 = 0"),
]
STYLES = [
    (0, "seq % 3 = 0", "'https://cdn.example.com/main.css'", "seq % 4 = 0"),
    (1, "seq % 10 = 0", "'https://cdn.example.com/font.woff'", "seq % 4 = 0"),
    (2, "seq % 15 = 0", "'https://cdn.example.com/theme' || CAST(seq AS STRING) || '.css'", "FALSE"),
]
REDIRECTS = [
    (0, "seq % 20 = 11", "url || '/new'", "'301'"),
    (1, "seq % 19 = 0", "url || '/'", "'302'"),
    (2, "seq % 20 = 8", f"'{SHOP}/gone'", "'301'"),
]
HREFLANG = [(0, "seq % 6 = 0", "'en'", "url"), (1, "seq % 6 = 0", "'fr'", "url")]

SIGNALS_B = "title,meta_desc,h1,meta_robots,canonical,redirect,content_encoding,body_text,multiples,links,scripts,images,resource_hints"
ROBOTS_A = "\n".join([
    "User-agent: *", "Disallow: /img", "Disallow: /assets/*.js", "not a directive",
    f"Sitemap: {SHOP}/sitemap.xml", f"Sitemap: {SHOP}/news2/sitemap.xml",
])


def _rows(spec, names) -> str:
    """SQL for an array of structs holding the list rows whose condition is true."""
    items = ", ".join(
        f"CASE WHEN {cond} THEN named_struct("
        + ", ".join(f"'{n}', {v}" for n, v in zip(names, values)) + ") END"
        for _, cond, *values in spec
    )
    return f"filter(array({items}), x -> x IS NOT NULL)"


def _firsts(spec, extra: str = "TRUE") -> str:
    items = ", ".join(f"CASE WHEN ({cond}) AND ({extra}) THEN {v} END" for _, cond, v, *_ in spec)
    return f"filter(array({items}), x -> x IS NOT NULL)"


def _in_head(spec) -> str:
    items = ", ".join(f"CASE WHEN ({cond}) AND ({head}) THEN {v} END" for _, cond, v, head in spec)
    return f"filter(array({items}), x -> x IS NOT NULL)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived scalars, one row per page, html included."""
    base = read(spark, sf_dir, "pages").selectExpr(*[f"{e} AS {n}" for n, e in BASE.items()])
    return base.selectExpr("seq", "crawl_id", "url", "peer", "html", *[f"{e} AS {n}" for n, e in SCALARS.items()])


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived crawl under the library's schema."""
    nav = f"""CASE WHEN origin <> '' THEN transform(
        regexp_extract_all(html, '{NAV_PATTERN}', 1),
        (h, i) -> named_struct('url', origin || h, 'text', h, 'nofollow', (seq + i) % 4 = 0))
        ELSE CAST(array() AS ARRAY<STRUCT<url: STRING, text: STRING, nofollow: BOOLEAN>>) END"""
    fixed = _rows([(p, c, v, "''", nf) for p, c, v, nf in LINKS], ("url", "text", "nofollow"))
    df = flat(spark, sf_dir).selectExpr(
        "* EXCEPT (h1_cell, h2_cell, nav_cell, content_type, content_encoding, set_cookie, preconnect, "
        "jsonld_type, jsonld_author_type, jsonld_context, peer, html, origin)",
        "h1_cell AS h1", "h2_cell AS h2",
        "preconnect AS preconnect_href", "nav_cell AS nav_links_url",
        f"concat({nav}, {fixed}) AS links",
        f"{_rows(IMAGES, ('src', 'alt'))} AS images",
        f"transform({_rows(REDIRECTS, ('url', 'reason'))}, "
        "r -> named_struct('url', r.url, 'reason', r.reason, 'time', CAST(NULL AS STRING))) AS redirects",
        f"{_rows(HREFLANG, ('lang', 'href'))} AS hreflang",
        f"{_firsts(SCRIPTS)} AS script_src", f"{_firsts(STYLES)} AS stylesheet_href",
        f"{_in_head(SCRIPTS)} AS head_script_src", f"{_in_head(STYLES)} AS head_stylesheet_href",
        "map_filter(map('content-type', content_type, 'content-encoding', content_encoding, "
        "'set-cookie', set_cookie), (k, v) -> v IS NOT NULL) AS resp_headers",
        "map_filter(map('@type', jsonld_type, 'author_@type', jsonld_author_type, "
        "'@context', jsonld_context), (k, v) -> v IS NOT NULL) AS jsonld",
    )
    return schema.conform(df)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived crawl as a table, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = new_path(spark, "crawl")
        write_crawl(crawl(spark, sf_dir), path)
        _STORED[key] = path
    return read_crawl(spark, _STORED[key])


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per crawl: mode, available signals, robots address."""
    ids = read(spark, sf_dir, "pages").selectExpr(f"{BASE['crawl_id']} AS crawl_id").distinct()
    return ids.selectExpr(
        "crawl_id",
        "CASE crawl_id WHEN 'a' THEN true WHEN 'b' THEN false END AS is_discovery",
        f"CASE crawl_id WHEN 'b' THEN split('{SIGNALS_B}', ',') END AS available_signals",
        f"CASE WHEN crawl_id <> 'c' THEN '{SHOP}/robots.txt' END AS robots_url",
        "crawl_id <> 'c' AS has_lighthouse", "crawl_id <> 'b' AS has_render",
        "CASE crawl_id WHEN 'b' THEN 'spider-export' ELSE 'crawl' END AS source",
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawls(spark, sf_dir).where("robots_url IS NOT NULL").select(
        "crawl_id", "robots_url",
        F.when(F.col("crawl_id") == "a", ROBOTS_A).otherwise("").alias("body"))


SITEMAP_ROWS = [
    ("seq % 4 = 0", "url"),
    ("seq % 4 = 1", "url || '/'"),
    ("seq % 50 = 0", f"'{SHOP}/orphan/' || CAST(seq AS STRING)"),
]


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    locs = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in SITEMAP_ROWS)
    return flat(spark, sf_dir).where("crawl_id <> 'c'").selectExpr(
        "crawl_id", "seq",
        f"explode(filter(array({locs}), x -> x IS NOT NULL)) AS loc",
    ).selectExpr("*", f"CASE WHEN loc = '{SHOP}/orphan/0' THEN 'parse error' END AS errors")


ASSET_STATUS = "CASE WHEN length(url) % 7 = 0 THEN 404 ELSE 200 END"
ASSET_BODY = "CASE length(url) % 3 WHEN 0 THEN 'a' || chr(10) || '@import url(x)' WHEN 1 THEN 'document.write(1)' ELSE repeat('x', 200) END"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (crawl_id, url) of images, scripts, styles, host variants and sitemap addresses."""
    c = stored(spark, sf_dir)
    srcs = F.concat("script_src", "stylesheet_href", F.transform("images", lambda i: i["src"]))
    variant = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    variants = F.when(variant != "", F.array(
        F.concat(F.lit("http://"), variant, F.lit("/")),
        F.concat(F.lit("https://www."), variant, F.lit("/")),
        F.concat(F.lit("https://"), variant, F.lit("/sitemap.xml")),
        F.concat(F.lit("https://"), variant, F.lit("/news2/sitemap.xml")))).otherwise(F.array().cast("array<string>"))
    return c.select("crawl_id", F.explode(F.concat(srcs, variants)).alias("url")).distinct()


def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).where("length(url) % 11 <> 0").selectExpr(
        "crawl_id", "url", f"CAST({ASSET_STATUS} AS BIGINT) AS status")


def asset_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).where("url LIKE '%.js%' OR url LIKE '%.css%'").selectExpr(
        "crawl_id", "url", f"{ASSET_BODY} AS body")


PSI_IDS = [
    ("largest-contentful-paint", "CAST(1000 + seq * 20 AS DOUBLE)"),
    ("cumulative-layout-shift", "CAST(seq % 7 AS DOUBLE) / 20"),
    ("uses-responsive-images", "NULL"), ("render-blocking-resources", "NULL"),
    ("uses-optimized-images", "NULL"), ("efficient-animated-content", "NULL"),
    ("modern-image-formats", "NULL"), ("preload-lcp-image", "NULL"),
    ("third-party-facades", "NULL"),
]
PSI_SCORE = "CASE WHEN seq % 3 = 0 THEN NULL ELSE CAST(seq % 20 AS DOUBLE) / 15 END"


def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(
        f"named_struct('audit_id', '{a}', 'score', {PSI_SCORE}, 'numeric_value', CAST({v} AS DOUBLE))"
        for a, v in PSI_IDS)
    return flat(spark, sf_dir).where("crawl_id <> 'c' AND seq % 5 = 0").selectExpr(
        "crawl_id", "url", f"inline(array({rows}))")


RENDER = {
    "ok": "seq % 25 <> 0",
    "has_errors": "seq % 15 = 0",
    "title_at_load": "title",
    "title_after_wait": "CASE WHEN seq % 20 = 0 THEN title || ' (1)' ELSE title END",
    "rendered_text_len": "CAST(seq * 13 % 1500 AS BIGINT)",
    "nav_link_count": "CAST(seq % 3 AS BIGINT)",
    "hidden_text_len": "CAST(seq % 400 AS BIGINT)",
    "pseudo_content_count": "CAST(seq % 2 AS BIGINT)",
    "overlay": "seq % 35 = 0",
}


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).where("crawl_id <> 'b' AND seq % 5 = 0").selectExpr(
        "crawl_id", "url",
        *[f"{e} AS {n}" for n, e in RENDER.items() if n != "has_errors"],
        f"CASE WHEN {RENDER['has_errors']} THEN array('boom') ELSE CAST(array() AS ARRAY<STRING>) END AS page_errors",
    )


# ---- the same inputs as DuckDB CTEs -------------------------------------
def _long(spec, names, source="flat0") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT crawl_id, seq, url, {pos} AS pos, "
        + ", ".join(f"{v} AS {n}" for n, v in zip(names, values))
        + f" FROM {source} WHERE {cond}" for pos, cond, *values in spec)


def ctes() -> dict[str, str]:
    """Name to SQL body, in dependency order."""
    base = ", ".join(f"{e} AS {n}" for n, e in BASE.items())
    scalars = ", ".join(f"{e} AS {n}" for n, e in SCALARS.items())
    psi_rows = "\nUNION ALL\n".join(
        f"SELECT crawl_id, seq, url, '{a}' AS audit_id, {PSI_SCORE} AS score, CAST({v} AS DOUBLE) AS numeric_value "
        "FROM crawl WHERE crawl_id <> 'c' AND seq % 5 = 0" for a, v in PSI_IDS)
    render_cols = ", ".join(f"{e} AS {n}" for n, e in RENDER.items())
    sitemap_rows = "\nUNION ALL\n".join(
        f"SELECT crawl_id, seq, {i} AS k, {v} AS loc FROM crawl WHERE crawl_id <> 'c' AND {c}"
        for i, (c, v) in enumerate(SITEMAP_ROWS))
    return {
        "flat0": f"SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM (SELECT {base} FROM pages)",
        "crawl": f"SELECT seq, crawl_id, url, peer, html, {scalars} FROM (SELECT {base} FROM pages)",
        "hrefs": f"""SELECT crawl_id, seq, url, origin, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS i
            FROM (SELECT *, regexp_extract_all(html, '{NAV_PATTERN}', 1) AS h FROM flat0 WHERE origin <> '')""",
        "links": f"""SELECT crawl_id, seq, url, i AS pos, origin || href AS link, (seq + i) % 4 = 0 AS nofollow FROM hrefs
            UNION ALL {_long(LINKS, ('link', 'nofollow'))}""",
        "images": _long(IMAGES, ("src", "alt")),
        "scripts": _long(SCRIPTS, ("src", "in_head")),
        "styles": _long(STYLES, ("href", "in_head")),
        "redirects": _long(REDIRECTS, ("hop", "reason")),
        "hreflang": _long(HREFLANG, ("lang", "href")),
        "crawls": f"""SELECT crawl_id, CASE crawl_id WHEN 'a' THEN true WHEN 'b' THEN false END AS is_discovery,
            CASE crawl_id WHEN 'b' THEN '{SIGNALS_B}' END AS signals,
            CASE WHEN crawl_id <> 'c' THEN '{SHOP}/robots.txt' END AS robots_url,
            crawl_id <> 'c' AS has_lighthouse, crawl_id <> 'b' AS has_render FROM (SELECT DISTINCT crawl_id FROM crawl)""",
        "sitemap": f"""SELECT crawl_id, seq, k, loc, CASE WHEN loc = '{SHOP}/orphan/0' THEN 'parse error' END AS errors
            FROM ({sitemap_rows})""",
        "assets": """SELECT crawl_id, url FROM (
            SELECT crawl_id, src AS url FROM images UNION SELECT crawl_id, src FROM scripts
            UNION SELECT crawl_id, href FROM styles
            UNION SELECT crawl_id, 'http://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' FROM crawl WHERE origin <> ''
            UNION SELECT crawl_id, 'https://www.' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' FROM crawl WHERE origin <> ''
            UNION SELECT crawl_id, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/sitemap.xml' FROM crawl WHERE origin <> ''
            UNION SELECT crawl_id, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/news2/sitemap.xml' FROM crawl WHERE origin <> '')""",
        "asset_status": f"SELECT crawl_id, url, {ASSET_STATUS} AS status FROM assets WHERE length(url) % 11 <> 0",
        "asset_body": f"SELECT crawl_id, url, {ASSET_BODY} AS body FROM assets WHERE url LIKE '%.js%' OR url LIKE '%.css%'",
        "psi": psi_rows,
        "render": f"SELECT crawl_id, seq, url, {render_cols} FROM crawl WHERE crawl_id <> 'b' AND seq % 5 = 0",
    }

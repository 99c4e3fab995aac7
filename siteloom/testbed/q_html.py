"""Queries on HTML extraction over whole pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.plans.report import crawl_detail
from siteloom.schema import conform
from siteloom.session import materialise
from siteloom.sources import html as X
from siteloom.sources.markup import jsonld
from siteloom.testbed import derived as D, duck as Q
from siteloom.testbed.registry import query

# The pages' own markup is regular; metadata they lack is prepended as an extra
# head built from page_id, and the same text is parsed on both sides.
RICH = """'<head><meta name="robots" content="index,' || CASE WHEN page_id % 3 = 0 THEN 'no' ELSE '' END || 'follow">'
 || '<meta content="d' || CAST(page_id AS STRING) || '" name="description"><link rel="canonical" href="/c/' || CAST(page_id AS STRING) || '">'
 || '<!-- <title>not me</title> --><link rel="alternate" hreflang="en" href="/en"><link rel="alternate" hreflang="fr" href="/fr">'
 || '<script src="/a.js"></script><script src="/b' || CAST(page_id % 7 AS STRING) || '.js" async></script><link href="/m.css" rel="stylesheet">'
 || '<link rel="preconnect" href="https://cdn.example.com"><link rel=next href="?page=2"></head>'
 || '<body><img src="/i/' || CAST(page_id AS STRING) || '.png" alt="x>y"><img alt="none"><a rel="nofollow" href="b/../c">Go</a></body>'"""


def _plain(text: str) -> str:
    """SQL for ``text`` with the references that the supplied pages hold decoded."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "' || chr(39) || '"), ("&#x27;", "' || chr(39) || '"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{sign}')"
    return text


def _pages(spark, sf):
    return D.read(spark, sf, "pages")


def _rich(spark, sf):
    return _pages(spark, sf).selectExpr("page_id", "url", f"{RICH} || html AS html")


@query("html_core", f"""SELECT page_id, {_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
    {_plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang FROM pages""")
def html_core(spark, sf):
    p = X.extract(_pages(spark, sf), {"t": "title::text", "h": "h1::text", "html_lang": "html::attr(lang)"})
    return p.select("page_id", F.col("t")[0].alias("title"), F.col("h")[0].alias("h1"),
                    F.col("html_lang")[0].alias("html_lang"))



@query("html_counts", """SELECT page_id, 1 AS head_count, len(regexp_extract_all(html, '<title>')) AS title_count,
    len(regexp_extract_all(regexp_extract(html, '(?s)<head>(.*?)</head>', 1), '<title>')) AS title_in_head_count,
    0 AS canonical_total_count, 0 AS canonical_in_head_count, 0 AS meta_desc_total_count, 0 AS meta_desc_in_head_count FROM pages""")
def html_counts(spark, sf):
    counts = X.structure_counts()
    return X.prepared(_pages(spark, sf), X.COUNTED_TAGS).select("page_id", *[c.alias(n) for n, c in counts.items()])


@query("html_rich_counts", """SELECT page_id, 2 AS head_count, 1 AS title_count, 1 AS title_in_head_count, 1 AS canonical_total_count,
    1 AS canonical_in_head_count, 1 AS meta_desc_total_count, 1 AS meta_desc_in_head_count FROM pages""")
def html_rich_counts(spark, sf):
    """With a commented-out title; the page's own head is a second one and its title counts as inside."""
    counts = X.structure_counts()
    return X.prepared(_rich(spark, sf), X.COUNTED_TAGS).select("page_id", *[c.alias(n) for n, c in counts.items()])


@query("html_links", f"""SELECT page_id, i AS pos, {Q.scheme('url')} || '://' || {Q.netloc('url')} || href AS link, txt AS text, false AS nofollow FROM (
    SELECT page_id, url, {_plain("""unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1))""")} AS href,
    {_plain("""unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))""")} AS txt,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS i FROM pages)""")
def html_links(spark, sf):
    p = _pages(spark, sf).select("page_id", F.posexplode(X.links(X.markup("html"), F.col("url"))).alias("pos", "l"))
    return p.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("l.url").alias("link"),
                    F.col("l.text").alias("text"), F.col("l.nofollow").alias("nofollow"))


_ASSETS = ("script_src", "stylesheet_href", "head_script_src", "preconnect_href", "rel_next", "hreflang_hreflang",
           "hreflang_href", "meta_robots", "canonical_all", "meta_desc_all")


@query("html_assets", """SELECT page_id, '/a.js,/b' || CAST(page_id % 7 AS STRING) || '.js' AS script_src, '/m.css' AS stylesheet_href,
    '/a.js,/b' || CAST(page_id % 7 AS STRING) || '.js' AS head_script_src, 'https://cdn.example.com' AS preconnect_href, '?page=2' AS rel_next,
    'en,fr' AS hreflang_hreflang, '/en,/fr' AS hreflang_href,
    'index,' || CASE WHEN page_id % 3 = 0 THEN 'no' ELSE '' END || 'follow' AS meta_robots, '/c/' || CAST(page_id AS STRING) AS canonical_all,
    'd' || CAST(page_id AS STRING) AS meta_desc_all FROM pages""")
def html_assets(spark, sf):
    wanted = {n: s for n, s in X.merged_selectors().items() if n in _ASSETS}
    p = X.extract(_rich(spark, sf), wanted)
    return p.select("page_id", *[F.array_join(n, ",").alias(n) for n in _ASSETS])


@query("html_custom", """SELECT page_id, 'https://cdn.example.com' AS hints, '' AS prev, len(regexp_extract_all(html, '<p>|<p ')) AS paragraphs,
    regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def html_custom(spark, sf):
    """A caller's own selectors."""
    own = {"hints": "link[rel=preconnect]::attr(href)", "prev": "link[rel=prev]::attr(href)", "charset": "meta[charset]::attr(charset)"}
    cols = {n: X.Pick.of(s).values() for n, s in own.items()}
    return X.prepared(_rich(spark, sf), {"link", "meta", "p"}).select(
        "page_id", *[F.array_join(c, ",").alias(n) for n, c in cols.items()],
        F.size(X.Pick("p").tags()).cast("bigint").alias("paragraphs"))


# Some pages end inside a reference.
_TEXT = _plain(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<script>.*?</script>|<!--.*?-->', '', 'g'), '(?s)</body>.*$', ''), '<[^>]*>', ' ', 'g'), '&amp$', '&amp;')""")


@query("html_body_text", rf"""SELECT page_id, trim(regexp_replace({_TEXT}, '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS body_text FROM pages""")
def html_body_text(spark, sf):
    return _pages(spark, sf).select("page_id", X.body_text(X.markup("html")).alias("body_text"))


@query("html_crawl_columns", f"""SELECT page_id, octet_length(encode(html)) AS size, {_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
    len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_nav,
    0 AS n_images, CAST(NULL AS STRING) AS canonical FROM pages""")
def html_crawl_columns(spark, sf):
    """All columns at once, as a crawl is built from stored pages."""
    return X.crawl_columns(_pages(spark, sf)).select(
        "page_id", "size", "title", F.size("links").cast("bigint").alias("n_links"),
        F.size("nav_links_url").cast("bigint").alias("n_nav"), F.size("images").cast("bigint").alias("n_images"), "canonical")


@query("html_images", f"""SELECT page_id, {Q.scheme('url')} || '://' || {Q.netloc('url')} || '/i/' || CAST(page_id AS STRING) || '.png' AS src, 'x>y' AS alt FROM pages""")
def html_images(spark, sf):
    p = X.prepared(_rich(spark, sf), {"img"}).select("page_id", F.explode(X.images(F.col("url"))).alias("i"))
    return p.select("page_id", "i.src", "i.alt")


_HEAD = """'<html><head><META http-equiv="Refresh" content="' || CAST(page_id AS STRING) || '; url=/r"><link rel="amphtml" href="/amp?a=1&amp;p=' || CAST(page_id AS STRING)
 || '"><link href=/p/' || CAST(page_id AS STRING) || ' rel=prev><link rel="preload" href="/f.woff"><link rel="x preload" href="/g.woff"><link rel="stylesheet" href="/a.css"></head><body>'
 || '<link rel="stylesheet" href="/b' || CAST(page_id AS STRING) || '.css">' || html || '</body></html>'"""


@query("html_head_links", """SELECT page_id, CAST(page_id AS STRING) || '; url=/r' AS meta_refresh, '/amp?a=1&p=' || CAST(page_id AS STRING) AS amphtml, '/p/' || CAST(page_id AS STRING) AS rel_prev,
    '/f.woff|/g.woff' AS preload_href, '/a.css' AS head_stylesheet_href, '/a.css|/b' || CAST(page_id AS STRING) || '.css' AS stylesheet_href FROM pages""")
def html_head_links(spark, sf):
    """Refresh, mobile and neighbour links, preloads, and style sheets inside and outside the head."""
    p = X.crawl_columns(_pages(spark, sf).selectExpr("page_id", "url", f"{_HEAD} AS html"))
    joined = lambda c: F.array_join(c, "|") if dict(p.dtypes)[c].startswith("array") else F.col(c)
    return p.select("page_id", *[joined(c).alias(c) for c in ("meta_refresh", "amphtml", "rel_prev", "preload_href", "head_stylesheet_href", "stylesheet_href")])


# Heads without an end tag, names inside quoted values, an alternate without language.
TRICKY = """'<html><head><meta content="say name=description now" name="keywords"><link rel="alternate" href="/feed' || CAST(page_id AS STRING) || '">'
 || '<link href="/de" rel="alternate" hreflang="de"><title>T' || CAST(page_id AS STRING) || '</title><meta name="description" content="own">'
 || '<body><img alt="a src=b.png c" src="/i' || CAST(page_id AS STRING) || '.png">' || substr(html, 1, 0) || '</body></html>'"""


@query("html_tricky", f"""SELECT page_id, 'own' AS meta_desc, 'say name=description now' AS meta_keywords, 'de' AS langs, '/de' AS hrefs,
    1 AS title_in_head_count, 1 AS meta_desc_in_head_count, {Q.scheme('url')} || '://' || {Q.netloc('url')} || '/i' || CAST(page_id AS STRING) || '.png' AS src FROM pages""")
def html_tricky(spark, sf):
    """Markup on which reading attributes by search, or heads by their end tag, goes wrong."""
    p = X.crawl_columns(_pages(spark, sf).selectExpr("page_id", "url", f"{TRICKY} AS html"))
    return p.select("page_id", "meta_desc", "meta_keywords", F.array_join(F.transform("hreflang", lambda h: h["lang"]), ",").alias("langs"),
                    F.array_join(F.transform("hreflang", lambda h: h["href"]), ",").alias("hrefs"), "title_in_head_count", "meta_desc_in_head_count",
                    F.col("images")[0]["src"].alias("src"))


# Character references in texts, addresses and fields; a base address on every second page; navigation and lists.
REFS = """'<head>' || CASE WHEN page_id % 2 = 0 THEN '<base href="/base/d&#105;r/">' ELSE '' END || '<title>Caf&eacute; &amp; T' || CAST(page_id AS STRING)
 || ' &#8211; &#x41;&copy 1</title><meta name="description" content="a &quot;b&quot; &amp;amp; c"><meta property="og:title" content="O&#39;' || CAST(page_id AS STRING)
 || '"><meta property="og:image" content="/1.png"><meta property="og:image" content="/2.png"><meta http-equiv="refresh" content="5;url=/r' || CAST(page_id AS STRING)
 || '"><link rel="prev" href="?p=1&amp;q=2"><link rel="amphtml" href="/amp/' || CAST(page_id AS STRING) || '"><link rel="stylesheet" href="/h.css?a=1&amp;b=2"><link rel="preload" href="/f.woff2">'
 || '<link rel="canonical" href="/c?x=' || CAST(page_id AS STRING) || '&amp;y=2"></head><body><h2>A&nbsp;B</h2><nav><a href="p?a=1&amp;b=' || CAST(page_id AS STRING)
 || '&copy=2&#38;d=3">L&amp;M</a></nav><img src="i.png?x=1&amp;y=' || CAST(page_id AS STRING) || '" alt="&lt;b&gt;"></body>'"""
_DIR = "CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/base/dir/' ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) END"
_ID = "CAST(page_id AS STRING)"


@query("html_references", f"""SELECT page_id, 'Café & T' || {_ID} || ' – A© 1' AS title, 'a "b" &amp; c' AS meta_desc, 'O' || chr(39) || {_ID} AS og_title,
    '/1.png@@/2.png' AS og_image, '5;url=/r' || {_ID} AS meta_refresh, '?p=1&q=2' AS rel_prev, '/amp/' || {_ID} AS amphtml,
    '/h.css?a=1&b=2' AS head_css, '/f.woff2' AS preload, '/c?x=' || {_ID} || '&y=2' AS canonical, 'A' || chr(160) || 'B' AS h2,
    {_DIR} || 'p?a=1&b=' || {_ID} || '&copy=2&d=3' AS link, 'L&M' AS link_text, {_DIR} || 'p?a=1&b=' || {_ID} || '&copy=2&d=3' AS nav,
    {_DIR} || 'i.png?x=1&y=' || {_ID} AS src, '<b>' AS alt, 1 + len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links FROM pages""")
def html_references(spark, sf):
    """References are decoded once, an unclosed one in an address only where it is no parameter name."""
    p = X.crawl_columns(_pages(spark, sf).selectExpr("page_id", "url", f"{REFS} || html AS html"))
    return p.select(
        "page_id", "title", "meta_desc", F.col("og")["og:title"].alias("og_title"), F.col("og")["og:image"].alias("og_image"), "meta_refresh", "rel_prev", "amphtml",
        F.array_join("head_stylesheet_href", "@@").alias("head_css"), F.array_join("preload_href", "@@").alias("preload"), "canonical", F.col("h2")[0].alias("h2"),
        F.col("links")[0]["url"].alias("link"), F.col("links")[0]["text"].alias("link_text"), F.col("nav_links_url")[0].alias("nav"),
        F.col("images")[0]["src"].alias("src"), F.col("images")[0]["alt"].alias("alt"), F.size("links").cast("bigint").alias("n_links"))


# Two blocks, one of them a list of nodes; every fifth page has a broken third one; a commented block and a script that is no markup.
JSONLD = """'<!-- <script type="application/ld+json">{"@type":"Hidden"}</script> --><script>var t = "<!-- type=application/ld+json";</script>'
 || '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"H]}' || CAST(page_id AS STRING)
 || '","author":{"@type":"Person","address":{"zip":"' || CAST(page_id % 7 AS STRING) || '"}},"tags":["x","y' || CAST(page_id AS STRING) || '"]}</script>'
 || '<script id=graph type="application/ld+json">{"@graph":[{"@type":["Product","Offer"],"price":1.5},{"@type":"Organization","id":' || CAST(page_id AS STRING) || '}]}</script>'
 || CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{"@type": </script>' ELSE '' END"""


@query("html_jsonld", f"""SELECT page_id, e.k AS path, e.v AS value FROM (SELECT page_id, unnest([
    {{'k': '@context', 'v': 'https://schema.org'}}, {{'k': '@type', 'v': 'Article'}}, {{'k': 'headline', 'v': 'H]}}' || {_ID}}},
    {{'k': 'author.@type', 'v': 'Person'}}, {{'k': 'author.address.zip', 'v': CAST(page_id % 7 AS STRING)}}, {{'k': 'tags', 'v': 'x@@y' || {_ID}}},
    {{'k': '1_@graph.@type', 'v': 'Product@@Offer@@Organization'}}, {{'k': '1_@graph.price', 'v': '1.5'}}, {{'k': '1_@graph.id', 'v': {_ID}}},
    {{'k': CASE WHEN page_id % 5 = 0 THEN '2_errors' END, 'v': 'not JSON'}}]) AS e FROM pages) WHERE e.k IS NOT NULL""")
def html_jsonld(spark, sf):
    """Every block, nested objects and lists flattened to key paths."""
    p = _pages(spark, sf).selectExpr("page_id", f"{JSONLD} || html AS html")
    return p.select("page_id", F.explode(jsonld("html")).alias("path", "value"))


@query("html_structured_types", """SELECT page_id, ['Product', 'Offer', 'Organization', 'Article', 'Person'][1 + CAST(i AS INTEGER)] AS type, CAST(i AS BIGINT) AS pos
    FROM pages, range(5) r(i)""")
def html_structured_types(spark, sf):
    """The detail report's types of a crawl built from such pages."""
    pages = _pages(spark, sf).selectExpr("page_id AS seq", "url", "200L AS status", f"{JSONLD} || html AS html")
    detail = crawl_detail(materialise(conform(X.crawl_columns(pages).drop("html"), "s"), "typed_crawl"))
    types = F.posexplode(F.split("Structured Data Types", r"\|")).alias("pos", "type")
    return detail.select(F.col("seq").alias("page_id"), types).withColumn("pos", F.col("pos").cast("bigint"))


# A list with items left open and one list inside another, a table without row ends, neighbours, classes, a form in words with references.
NESTED = """'<div id="m' || CAST(page_id AS STRING) || '" class="box wide"><p>one' || CAST(page_id AS STRING) || '<p class="note x">two &amp; <b>bold</b> end</div><ul class=menu><li>1<li>2<ul><li>in'
 || CAST(page_id % 9 AS STRING) || '</ul><li>3</ul><table><tr><td>a<td data-k="v' || CAST(page_id % 3 AS STRING) || '">b<tr><td>c</table><section><h3>T</h3><em>e' || CAST(page_id AS STRING)
 || '</em><span>s</span></section></p><br>'"""
OWN_CSS = {
    "direct": "div.box > p::text", "plain": "div.wide p:not(.note)::text", "deep": "ul.menu li li::text", "second": "ul.menu > li:nth-child(2)::text",
    "cell": "tr > td[data-k^=v]::text", "beside": "h3 + em::text", "after": "h3 ~ span::text, #nothing b::text", "kinds": "td:first-child::text"}
OWN_XPATH = {"items": "count(//ul[contains(@class, 'menu')]//li)", "whole": "//p[contains(@class, 'note')]//text()", "last": "//tr/td[last()]/text()", "keys": "//td[@data-k]/@data-k"}


@query("html_selectors", f"""SELECT page_id, 'one' || {_ID} || '@@two & @@ end' AS direct, 'one' || {_ID} AS plain, 'in' || CAST(page_id % 9 AS STRING) AS deep, '2' AS second,
    'b' AS cell, 'e' || {_ID} AS beside, 's' AS after, 'a@@c' AS kinds, 4 AS items, 'two & @@bold@@ end' AS whole, 'b@@c' AS last,
    'v' || CAST(page_id % 3 AS STRING) AS keys FROM pages""")
def html_selectors(spark, sf):
    """A caller's selectors that need the element tree, in front of every whole page."""
    p = X.extract(_pages(spark, sf).selectExpr("page_id", f"{NESTED} || html AS html"), OWN_CSS, xpaths=OWN_XPATH)
    return p.select("page_id", "items", *(F.array_join(n, "@@").alias(n) for n in (*OWN_CSS, *OWN_XPATH) if n != "items"))

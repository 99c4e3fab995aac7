"""Queries on summaries, link / redirect / image analyses and the detail report."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import analysis as A, hosts as H
from siteloom.plans import report as R
from siteloom.testbed import derived as D, duck as Q
from siteloom.testbed.registry import query

EXTRA = {
    "site_hosts": f"SELECT crawl_id, {Q.host('url')} AS host, count(*) AS pages, min(seq) AS first_seq FROM crawl GROUP BY ALL",
    "link_rows": f"""SELECT l.*, {Q.host('link')} AS host,
        EXISTS (SELECT 1 FROM site_hosts h WHERE h.crawl_id = l.crawl_id AND h.host = {Q.host('link')}) AS internal FROM links l""",
}


def _key(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'null')"


@query("status_counts", f"SELECT crawl_id, {_key('status')} AS value, count(*) AS n FROM crawl GROUP BY ALL")
def status_counts(spark, sf):
    return A.value_counts(D.stored(spark, sf), "status", ["crawl_id"])


@query("depth_counts", f"SELECT crawl_id, {_key('depth')} AS value, count(*) AS n FROM crawl GROUP BY ALL")
def depth_counts(spark, sf):
    return A.value_counts(D.stored(spark, sf), "depth", ["crawl_id"])


@query("lineitem_value_counts", """SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY ALL""")
def lineitem_value_counts(spark, sf):
    """Whole doubles are printed without decimals."""
    return A.value_counts(D.read(spark, sf, "lineitem"), "l_quantity")


@query("content_types", """SELECT crawl_id, trim(split_part(value, ';', 1)) AS content_type, sum(n)::BIGINT AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY n DESC, value) AS r FROM (
        SELECT crawl_id, coalesce(content_type, 'null') AS value, count(*) AS n FROM crawl GROUP BY ALL)) WHERE r <= 15 GROUP BY ALL""")
def content_types(spark, sf):
    return A.content_types(D.stored(spark, sf))


@query("crawl_summary", f"""SELECT crawl_id, 'rows' AS section, '' AS value, count(*) AS n FROM crawl GROUP BY ALL
    UNION ALL SELECT crawl_id, 'status', {_key('status')}, count(*) FROM crawl GROUP BY ALL
    UNION ALL SELECT crawl_id, 'depth', {_key('depth')}, count(*) FROM crawl GROUP BY ALL
    UNION ALL SELECT DISTINCT crawl_id, 'columns', '', 46 FROM crawl
    UNION ALL SELECT crawl_id, 'content_type', trim(split_part(coalesce(content_type, 'null'), ';', 1)), count(*) FROM crawl GROUP BY ALL""")
def crawl_summary(spark, sf):
    return A.crawl_summary(D.stored(spark, sf))


@query("primary_host", """SELECT crawl_id, host AS primary_host, pages FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY pages DESC, first_seq) AS r FROM site_hosts) WHERE r = 1""", EXTRA)
def primary_host(spark, sf):
    return H.primary_hosts(H.crawl_hosts(D.stored(spark, sf)))


@query("link_facts", """SELECT crawl_id, seq, url, link, nofollow, host, internal FROM link_rows""", EXTRA)
def link_facts(spark, sf):
    c = D.stored(spark, sf)
    links, hosts = A.link_facts(c), H.hosts_table(c)
    inside = A.internal_links(links, hosts).select("crawl_id", "seq", "pos", F.lit(True).alias("internal"))
    return links.join(inside, ["crawl_id", "seq", "pos"], "left").select(
        "crawl_id", "seq", "url", "link", "nofollow", "host", F.coalesce("internal", F.lit(False)).alias("internal"))


@query("link_analysis", """SELECT crawl_id, count(*) AS total_links, count_if(internal) AS internal_links,
    count_if(NOT internal) AS external_links, count_if(nofollow) AS nofollow_links,
    count(DISTINCT CASE WHEN internal THEN link END) AS unique_internal_targets FROM link_rows GROUP BY crawl_id""", EXTRA)
def link_analysis(spark, sf):
    c = D.stored(spark, sf)
    return A.link_analysis(A.link_facts(c), H.hosts_table(c))


@query("top_targets", """SELECT crawl_id, link, n FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY n DESC, link) AS r
    FROM (SELECT crawl_id, link, count(*) AS n FROM link_rows WHERE internal GROUP BY ALL)) WHERE r <= 20""", EXTRA)
def top_targets(spark, sf):
    c = D.stored(spark, sf)
    return A.top_targets(A.link_facts(c), H.hosts_table(c))


@query("inlinks", f"""SELECT crawl_id, {Q.strict('trim(link)')} AS target, count(*) AS inlinks, count(DISTINCT url) AS unique_inlinks
    FROM link_rows WHERE internal GROUP BY ALL""", EXTRA)
def inlinks(spark, sf):
    c = D.stored(spark, sf)
    return A.inlinks(A.link_facts(c), H.hosts_table(c))


@query("redirect_facts", """SELECT r.crawl_id, r.seq, r.url, c.status, c.download_latency,
    row_number() OVER (PARTITION BY r.seq ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY r.seq) AS hops, hop, reason AS type
    FROM redirects r JOIN crawl c USING (seq)""")
def redirect_facts(spark, sf):
    return A.redirect_facts(D.stored(spark, sf))


@query("redirect_analysis", f"""SELECT r.crawl_id, 'total' AS section, '' AS value, count(*) AS n FROM redirects r GROUP BY ALL
    UNION ALL SELECT r.crawl_id, 'status', {_key('c.status')}, count(*) FROM redirects r JOIN crawl c USING (seq) GROUP BY ALL
    UNION ALL SELECT r.crawl_id, 'type', reason, count(*) FROM redirects r GROUP BY ALL""")
def redirect_analysis(spark, sf):
    return A.redirect_analysis(D.stored(spark, sf))


@query("image_analysis", """SELECT crawl_id, count(*) AS total_images, count(DISTINCT src) AS unique_images,
    count_if(trim(coalesce(alt, '')) = '') AS images_missing_alt FROM images GROUP BY ALL""")
def image_analysis(spark, sf):
    return A.image_analysis(A.image_facts(D.stored(spark, sf)))


@query("image_extensions", f"""SELECT crawl_id, extension, n FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY n DESC, extension) AS r FROM (
    SELECT crawl_id, coalesce(nullif(lower(regexp_extract({Q.path('src')}, '[^/.][^/]*([.][^./]+)$', 1)), ''), '(none)') AS extension, count(*) AS n
    FROM images GROUP BY ALL)) WHERE r <= 15""")
def image_extensions(spark, sf):
    return A.image_extensions(A.image_facts(D.stored(spark, sf)))


# ---- detail report ------------------------------------------------------------
def _cell(name: str) -> str:
    return f"CASE WHEN {name} IS NULL OR lower({name}) = 'nan' THEN [] WHEN {name} = '' THEN [] ELSE string_split({name}, '@@') END"


def _encoded(u: str) -> str:
    sql = f"url_encode({u})"
    for code, char in urls._SAFE.items():
        sql = f"replace({sql}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({sql}, '%2A', '*')"


_PHRASES = " ".join(f"WHEN {int(s)} THEN '{s.phrase}'" for s in HTTPStatus if "'" not in s.phrase)
_CANON = f"CASE WHEN seq % 9 = 4 THEN {Q.strict('(o || chr(47) || chr(112) || chr(97) || chr(116) || chr(104))')} ELSE {Q.strict('canonical')} END"

DETAIL = {
    "d0": f"""SELECT *, {_cell('h1_cell')} AS h1s, {_cell('h2_cell')} AS h2s, {Q.strict('trim(url)')} AS ukey,
        CASE WHEN {Q.netloc('url')} <> '' THEN {Q.scheme('url')} || '://' || {Q.netloc('url')} ELSE '' END AS o FROM crawl""",
    "d1": f"SELECT *, CASE WHEN canonical IS NULL THEN NULL WHEN canonical = '' THEN NULL ELSE {_CANON} END AS ckey FROM d0",
    "outs": """SELECT seq, count(*) AS outl, count(DISTINCT link) AS uoutl, count_if(host <> '' AND NOT internal) AS ext,
        count(DISTINCT CASE WHEN host <> '' AND NOT internal THEN link END) AS uext FROM link_rows GROUP BY seq""",
    "ins": f"""SELECT crawl_id, {Q.strict('trim(link)')} AS ukey, count(*) AS inl, count(DISTINCT url) AS uinl FROM link_rows WHERE internal GROUP BY ALL""",
    "imgs": "SELECT seq, count(*) AS n, count_if(trim(coalesce(alt, '')) = '') AS noalt FROM images GROUP BY seq",
    "reds": "SELECT seq, max_by(hop, pos) AS hop, max_by(reason, pos) AS reason FROM redirects GROUP BY seq",
    "langs": "SELECT seq, min_by(lang, pos) AS lang, count(*) AS n FROM hreflang GROUP BY seq",
    "reason_of": """SELECT *, CASE WHEN status IS NULL THEN 'No response' WHEN status >= 400 THEN 'Non-200 (' || status || ')'
        WHEN status >= 300 THEN 'Redirect' WHEN lower(coalesce(meta_robots, '')) LIKE '%noindex%' THEN 'Noindex'
        WHEN canonical <> '' AND ckey IS DISTINCT FROM ukey THEN 'Canonicalised' ELSE '' END AS why FROM d1""",
    **EXTRA,
}

DETAIL_SQL = f"""SELECT c.crawl_id, c.seq, c.url AS "Address", c.status AS "Status Code", CASE c.status {_PHRASES} ELSE '' END AS "Status",
    CASE WHEN why = '' THEN 'Indexable' ELSE 'Non-Indexable' END AS "Indexability", why AS "Indexability Reason",
    coalesce(content_type, '') AS "Content-Type", coalesce(content_encoding, '') AS "Content-Encoding",
    round(download_latency, 4) AS "Response Time", size AS "Size (bytes)", depth AS "Crawl Depth", crawl_time AS "Crawl Timestamp",
    html_lang AS "Language", title AS "Title 1", length(title) AS "Title 1 Length", coalesce(meta_desc, '') AS "Meta Description 1",
    length(coalesce(meta_desc, '')) AS "Meta Description 1 Length", '' AS "Meta Keywords 1", coalesce(h1s[1], '') AS "H1-1",
    length(coalesce(h1s[1], '')) AS "H1-1 Length", coalesce(h1s[2], '') AS "H1-2", len(h1s) AS "H1 Count",
    coalesce(h2s[1], '') AS "H2-1", coalesce(h2s[2], '') AS "H2-2", len(h2s) AS "H2 Count", coalesce(meta_robots, '') AS "Meta Robots 1",
    '' AS "X-Robots-Tag 1", '' AS "Meta Refresh 1", coalesce(canonical, '') AS "Canonical Link Element 1",
    coalesce(canonical <> '' AND ckey = c.ukey, false) AS "Canonical Is Self", '' AS "rel=next", '' AS "rel=prev", '' AS "amphtml Link Element",
    len(regexp_extract_all(body_text, '[^\\s\\x{{85}}\\x{{a0}}]+')) AS "Word Count",
    CASE WHEN size = 0 THEN 0.0 ELSE round(100.0 * length(body_text) / size, 1) END AS "Text Ratio",
    coalesce(inl, 0) AS "Inlinks", coalesce(uinl, 0) AS "Unique Inlinks", coalesce(outl, 0) AS "Outlinks", coalesce(uoutl, 0) AS "Unique Outlinks",
    coalesce(ext, 0) AS "External Outlinks", coalesce(uext, 0) AS "Unique External Outlinks",
    coalesce(imgs.n, 0) AS "Images", coalesce(noalt, 0) AS "Images Missing Alt Text", coalesce(langs.lang, '') AS "Hreflang 1",
    coalesce(langs.n, 0) AS "Hreflang Count", coalesce(reds.hop, '') AS "Redirect URL", coalesce(reds.reason, '') AS "Redirect Type",
    '' AS "Last-Modified", '' AS "Server", ip_address AS "IP Address", CASE WHEN coalesce(set_cookie, '') <> '' THEN 'Yes' ELSE 'No' END AS "Cookies",
    CASE WHEN c.seq % 12 = 0 THEN 'NewsOrganization|Person' WHEN c.seq % 6 = 0 THEN 'NewsOrganization' WHEN c.seq % 6 = 1 THEN 'Product' ELSE '' END AS "Structured Data Types",
    CASE WHEN c.seq % 12 = 0 THEN 2 WHEN c.seq % 6 IN (0, 1) THEN 1 ELSE 0 END AS "Structured Data Count",
    length(c.url) AS "URL Length", {_encoded('c.url')} AS "URL Encoded Address"
    FROM reason_of c LEFT JOIN outs USING (seq) LEFT JOIN ins ON ins.crawl_id = c.crawl_id AND ins.ukey = c.ukey
    LEFT JOIN imgs USING (seq) LEFT JOIN reds USING (seq) LEFT JOIN langs USING (seq)"""


@query("crawl_detail", DETAIL_SQL, DETAIL)
def crawl_detail(spark, sf):
    return R.crawl_detail(D.stored(spark, sf))


@query("detail_totals", """SELECT crawl_id, count(*) AS rows, 54 AS column_count, count_if(why = '') AS indexable_urls,
    count_if(why <> '') AS non_indexable_urls FROM reason_of GROUP BY crawl_id""", DETAIL)
def detail_totals(spark, sf):
    return R.detail_totals(R.crawl_detail(D.stored(spark, sf)))

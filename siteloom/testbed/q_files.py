"""Queries on file sources: JSON lines, robots, sitemaps, lab payloads, spider exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators.scope import image_scope
from siteloom.plans.audit import Audit
from siteloom.plans.report import crawl_detail
from siteloom.session import new_path
from siteloom.sources import crawl as C, lab, robots as R, sitemap as S, spider_export as E
from siteloom.testbed import derived as D, duck as Q
from siteloom.testbed.q_analysis import DETAIL, DETAIL_SQL
from siteloom.testbed.registry import query


# ---- crawler output ---------------------------------------------------------
@query("crawl_from_json_lines", """SELECT crawl_id, seq, url, status, title, meta_robots, canonical, content_type,
    (SELECT count(*) FROM links l WHERE l.seq = c.seq) AS n_links, (SELECT count_if(nofollow) FROM links l WHERE l.seq = c.seq) AS n_nofollow,
    (SELECT count(*) FROM images i WHERE i.seq = c.seq) AS n_images, (SELECT count(*) FROM redirects r WHERE r.seq = c.seq) AS n_hops,
    jsonld_type FROM crawl c""")
def crawl_from_json_lines(spark, sf):
    """Flat crawler output written as JSON lines, read back under the crawl schema."""
    c = D.stored(spark, sf)
    cell = lambda items, f: F.nullif(F.array_join(F.transform(items, lambda x: F.coalesce(x[f].cast("string"), F.lit(""))), "@@"), F.lit(""))
    flat = c.select(
        "crawl_id", "seq", "url", F.col("status").cast("double"), "title", "meta_robots", "canonical",
        cell("links", "url").alias("links_url"), cell("links", "nofollow").alias("links_nofollow"),
        cell("images", "src").alias("img_src"), cell("images", "alt").alias("img_alt"),
        cell("redirects", "url").alias("redirect_urls"), F.try_element_at("resp_headers", F.lit("content-type")).alias("resp_headers_Content-Type"),
        F.try_element_at("jsonld", F.lit("@type")).alias("jsonld_@type"))
    path = new_path(spark, "crawl-json")
    flat.write.json(path)
    back = C.read_crawl_json(spark, path, "unused")
    return back.select(
        "crawl_id", "seq", "url", "status", "title", "meta_robots", "canonical",
        F.try_element_at("resp_headers", F.lit("content-type")).alias("content_type"),
        F.size("links").cast("bigint").alias("n_links"),
        F.size(F.filter("links", lambda k: k["nofollow"])).cast("bigint").alias("n_nofollow"),
        F.size("images").cast("bigint").alias("n_images"), F.size("redirects").cast("bigint").alias("n_hops"),
        F.try_element_at("jsonld", F.lit("@type")).alias("jsonld_type"))


@query("header_sweep", "SELECT crawl_id, seq, url, status, coalesce(content_type, '') AS content_type FROM crawl")
def header_sweep(spark, sf):
    path = new_path(spark, "headers-json")
    D.flat(spark, sf).selectExpr("crawl_id", "seq", "url", "status", "content_type AS `resp_headers_Content-Type`").write.json(path)
    return C.read_header_sweep(spark, path, "unused").select(
        "crawl_id", "seq", "url", "status", F.coalesce(F.try_element_at("resp_headers", F.lit("content-type")), F.lit("")).alias("content_type"))


@query("image_shards", """SELECT page_id, img_src, width, height FROM (SELECT page_id, url || '/i.png' AS img_src,
    length(html) % 400 AS width, length(url) % 100 AS height FROM pages) WHERE width >= 50 AND height >= 20""")
def image_shards(spark, sf):
    path = new_path(spark, "shards")
    images = D.read(spark, sf, "pages").selectExpr(
        "page_id", "url || '/i.png' AS img_src", "CAST(length(html) % 400 AS BIGINT) AS width", "CAST(length(url) % 100 AS BIGINT) AS height")
    images.write.json(path)
    return image_scope(C.read_image_shards(spark, path), 50, 20).select("page_id", "img_src", "width", "height")


# A file does not tell an empty cell from a missing one.
_FILED = ", ".join(f"""coalesce("{c}", '') AS "{c}\"""" for c in ("Language", "Crawl Timestamp", "IP Address", "Title 1", "Redirect Type"))


@query("detail_csv", f"""SELECT * EXCLUDE (crawl_id, seq) REPLACE ({_FILED}) FROM ({DETAIL_SQL})""", DETAIL)
def detail_csv(spark, sf):
    """The detail report written as CSV and read back, every column in its own kind."""
    path = new_path(spark, "crawl-detail-csv")
    report = crawl_detail(D.stored(spark, sf))
    C.write_detail_csv(report, path)
    kinds = [f for f in report.schema if f.name not in ("crawl_id", "seq")]
    back = E.read_export(spark, path)
    return back.select(*[
        (F.coalesce(f"`{f.name}`", F.lit("")) if f.dataType.typeName() == "string" else F.nullif(F.col(f"`{f.name}`"), F.lit("")).cast(f.dataType)).alias(f.name) for f in kinds])


# ---- robots ------------------------------------------------------------------
# One robots file per host of the pages; its lines depend on the host's name.
_ROBOTS_BODY = """'# file of ' || host || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /en/' || chr(10) || 'Allow: /en/1' || chr(10)
 || CASE WHEN length(host) % 2 = 0 THEN 'Disallow: /*?page=' || chr(10) ELSE '' END
 || 'User-agent: Bot' || chr(10) || 'Disallow: /' || CASE WHEN length(host) % 3 = 0 THEN 'fr' ELSE '' END || ' # all' || chr(10)
 || CASE WHEN length(host) % 5 = 0 THEN 'Allow: /*5$' || chr(10) ELSE '' END
 || 'Sitemap: https://' || host || '/sitemap.xml' || chr(10) || CASE WHEN length(host) % 4 = 0 THEN 'sitemap :https://' || host || '/news.xml' ELSE 'junk' END"""
_HOSTS = f"SELECT DISTINCT {Q.host('url')} AS host FROM pages"
ROBOTS = {
    "robot_hosts": _HOSTS,
    "robot_files": f"SELECT host, {_ROBOTS_BODY} AS body FROM robot_hosts",
    "robot_lines": """SELECT host, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM robot_files""",
    "robot_rows": """SELECT host, line_no, lower(trim(split_part(t, ':', 1))) AS directive, trim(regexp_replace(t, '^[^:]*:', '')) AS content
        FROM (SELECT *, trim(split_part(line, '#', 1)) AS t FROM robot_lines) WHERE t LIKE '%:%'""",
}


def _robot_files(spark, sf):
    hosts = D.read(spark, sf, "pages").select(urls.host("url").alias("host")).distinct()
    return hosts.selectExpr("host", f"{_ROBOTS_BODY} AS body")


@query("robots_table", "SELECT host, line_no, directive, content FROM robot_rows", ROBOTS)
def robots_table(spark, sf):
    return R.directive_table(_robot_files(spark, sf)).select(
        "host", F.col("line_no").cast("bigint").alias("line_no"), "directive", "content")


@query("robots_directives", "SELECT directive, count(*) AS n FROM robot_rows GROUP BY ALL", ROBOTS)
def robots_directives(spark, sf):
    return R.directive_counts(_robot_files(spark, sf))


@query("robots_rules", """SELECT host, line_no, agent, directive, content AS rule FROM (SELECT *,
    last_value(CASE WHEN directive = 'user-agent' THEN content END IGNORE NULLS) OVER (PARTITION BY host ORDER BY line_no) AS agent FROM robot_rows)
    WHERE directive IN ('allow', 'disallow')""", ROBOTS)
def robots_rules(spark, sf):
    return R.agent_rules(_robot_files(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("robots_disallowed", """SELECT host, content AS rule FROM (SELECT *,
    last_value(CASE WHEN directive = 'user-agent' THEN content END IGNORE NULLS) OVER (PARTITION BY host ORDER BY line_no) AS agent FROM robot_rows)
    WHERE directive = 'disallow' AND agent = '*' AND content <> ''""", ROBOTS)
def robots_disallowed(spark, sf):
    return R.disallowed(_robot_files(spark, sf)).select("host", "rule")


# The rules of each file are known, so the longest match is spelt out here.
_CAN = """CASE WHEN agent <> 'Other' THEN
    CASE WHEN length(host) % 3 = 0 THEN CASE WHEN target NOT LIKE '/fr%' THEN true ELSE length(host) % 5 = 0 AND target LIKE '/%5' AND length('/*5$') > length('/fr') END
    ELSE length(host) % 5 = 0 AND target LIKE '/%5' END
  ELSE CASE WHEN length(host) % 2 = 0 AND regexp_matches(target, '^/.*[?]page=') THEN false
    WHEN target LIKE '/en/1%' THEN true WHEN target LIKE '/en/%' THEN false ELSE true END END"""


@query("robots_can_fetch", f"""SELECT page_id, agent, {_CAN} AS can_fetch FROM (SELECT page_id, {Q.host('url')} AS host,
    {Q.path('url')} || CASE WHEN {Q.query('url')} <> '' THEN '?' || {Q.query('url')} ELSE '' END AS target, unnest(['Mozilla/5.0 (compatible; bot/2.1)', 'Other']) AS agent FROM pages)""")
def robots_can_fetch(spark, sf):
    pages = D.read(spark, sf, "pages").select("page_id", "url", urls.host("url").alias("host"))
    return R.can_fetch(pages, _robot_files(spark, sf), ["Mozilla/5.0 (compatible; bot/2.1)", "Other"], ["host"]).select("page_id", "agent", "can_fetch")


@query("robots_can_fetch_totals", f"""SELECT agent, count_if(ok) AS allowed, count_if(NOT ok) AS blocked, count(*) AS rows FROM (
    SELECT agent, {_CAN} AS ok FROM (SELECT {Q.host('url')} AS host,
    {Q.path('url')} || CASE WHEN {Q.query('url')} <> '' THEN '?' || {Q.query('url')} ELSE '' END AS target, unnest(['Mozilla/5.0 (compatible; bot/2.1)', 'Other']) AS agent FROM pages)) GROUP BY agent""")
def robots_can_fetch_totals(spark, sf):
    return robots_can_fetch(spark, sf).groupBy("agent").agg(
        F.count_if("can_fetch").alias("allowed"), F.count_if(~F.col("can_fetch")).alias("blocked"), F.count("*").alias("rows"))


@query("robots_sitemaps", """SELECT host AS crawl_id, CAST(0 AS BIGINT) AS pos, 'https://' || host || '/sitemap.xml' AS loc FROM robot_hosts
    UNION ALL SELECT host, 1, 'https://' || host || '/news.xml' FROM robot_hosts WHERE length(host) % 4 = 0""", ROBOTS)
def robots_sitemaps(spark, sf):
    return R.sitemap_lines(_robot_files(spark, sf).withColumnRenamed("host", "crawl_id")).withColumn("pos", F.col("pos").cast("bigint"))


_POOR_BODY = f"""CASE length(host) % 6 WHEN 0 THEN NULL WHEN 1 THEN chr(10) || ' <!DOCTYPE html><p>User-agent: no' WHEN 2 THEN 'moved: elsewhere' || chr(10) || '# disallow: x'
 WHEN 3 THEN '# nothing here' || chr(10) WHEN 4 THEN '' ELSE {_ROBOTS_BODY} END"""


@query("robots_rejects", f"""SELECT host, raw, CASE length(host) % 6 WHEN 0 THEN 'no body' WHEN 1 THEN 'markup' ELSE 'no known directive' END AS reason
    FROM (SELECT host, {_POOR_BODY} AS raw FROM robot_hosts) WHERE length(host) % 6 < 3""", {"robot_hosts": _HOSTS})
def robots_rejects(spark, sf):
    """Files that are missing, pages in their place, texts without a rule."""
    hosts = D.read(spark, sf, "pages").select(urls.host("url").alias("host")).distinct()
    return R.rejected_files(hosts.selectExpr("host", f"{_POOR_BODY} AS body"))


# ---- sitemaps -------------------------------------------------------------------
# One sitemap document per page, listed by an index per host, indexes by one root.
_DOC_URL = "'https://maps.example.com/' || CAST(page_id AS STRING) || '.xml'"
_DOC = """CASE WHEN page_id % 11 = 5 THEN '<html>gone</html>' ELSE '<?xml version="1.0"?><urlset><!-- <url><loc>no</loc></url> -->'
 || '<url><loc>' || replace(url, '&', '&amp;') || '</loc><lastmod>2024-01-01</lastmod></url>'
 || '<url> <loc><![CDATA[' || url || '/x]]></loc><news:news><news:title>N' || CAST(page_id AS STRING) || '</news:title></news:news></url></urlset>' END"""


def _docs(spark, sf):
    pages = D.read(spark, sf, "pages").selectExpr(f"{_DOC_URL} AS url", f"{_DOC} AS body", "page_id")
    group = F.concat(F.lit("https://maps.example.com/index-"), (F.col("page_id") / 10).cast("bigint"), F.lit(".xml"))
    indexes = pages.select(group.alias("u"), "url", (F.col("page_id") / 10).cast("bigint").alias("g")).groupBy("u", "g").agg(
        F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""),
                 F.lit("</sitemapindex>")).alias("body")).select(F.col("u").alias("url"), "body")
    return pages.select("url", "body").unionByName(indexes)


_SITEMAP_ROWS = f"""SELECT {_DOC_URL} AS sitemap, unnest([url, url || '/x']) AS loc, unnest(['2024-01-01', NULL]) AS lastmod,
    unnest([NULL, 'N' || CAST(page_id AS STRING)]) AS news_title, NULL AS errors FROM pages WHERE page_id % 11 <> 5
    UNION ALL SELECT {_DOC_URL}, NULL, NULL, NULL, 'not a sitemap document' FROM pages WHERE page_id % 11 = 5"""


@query("sitemap_urls", _SITEMAP_ROWS)
def sitemap_urls(spark, sf):
    return S.sitemap_urls(_docs(spark, sf)).select("sitemap", "loc", "lastmod", "news_title", "errors")


_POOR_DOC = """CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN html WHEN 2 THEN '<urlset><url><loc>' || replace(url, '&', '&amp;') || '</loc></url><url><loc>ht'
 WHEN 3 THEN '<urlset><url><loc>a</loc></url><url><lastmod>' || CAST(page_id AS STRING) || '</lastmod></url><url><loc> </loc></url></urlset>'
 ELSE '<urlset><url><loc>a</loc></url></urlset>' END"""


@query("sitemap_rejects", f"""SELECT page_id, NULL AS place, {_POOR_DOC} AS raw, CASE page_id % 5 WHEN 0 THEN 'no body' WHEN 1 THEN 'not a sitemap document' ELSE 'cut document' END AS reason
    FROM pages WHERE page_id % 5 < 3
    UNION ALL SELECT page_id, unnest([1, 2]), unnest(['<lastmod>' || CAST(page_id AS STRING) || '</lastmod>', '<loc> </loc>']), 'entry without an address' FROM pages WHERE page_id % 5 = 3""")
def sitemap_rejects(spark, sf):
    """Documents that are missing, no sitemaps or cut, and entries without an address."""
    docs = D.read(spark, sf, "pages").selectExpr("page_id", f"{_DOC_URL} AS url", f"{_POOR_DOC} AS body")
    return S.rejected_documents(docs).select("page_id", F.col("place").cast("bigint").alias("place"), "raw", "reason")


@query("sitemap_expand", f"""SELECT sitemap, loc FROM ({_SITEMAP_ROWS})""")
def sitemap_expand(spark, sf):
    """From the index documents down to the URL rows."""
    start = D.read(spark, sf, "pages").selectExpr(
        "'https://maps.example.com/index-' || CAST(CAST(page_id / 10 AS BIGINT) AS STRING) || '.xml' AS url").distinct()
    return S.expand(start, _docs(spark, sf)).select("sitemap", "loc")


@query("sitemap_discovery", f"""SELECT host AS crawl_id, CASE WHEN length(host) % 6 <> 0 THEN 'https://' || host || '/sitemap.xml'
    ELSE 'https://' || host || '/news.xml' END AS sitemap FROM robot_hosts WHERE length(host) % 6 <> 0 OR length(host) % 4 = 0""", ROBOTS)
def sitemap_discovery(spark, sf):
    """Per host: the first of its candidates that has rows."""
    files = _robot_files(spark, sf).withColumnRenamed("host", "crawl_id")
    entry = "'<urlset><url><loc>https://' || crawl_id || '/</loc></url></urlset>'"
    # The usual file is an index of a document with rows, or of one without; the news file has rows.
    listed = "'<sitemapindex><sitemap><loc>https://' || crawl_id || '/part.xml</loc></sitemap></sitemapindex>'"
    docs = files.selectExpr("'https://' || crawl_id || '/sitemap.xml' AS url", f"{listed} AS body").unionByName(
        files.selectExpr("'https://' || crawl_id || '/part.xml' AS url",
                         f"CASE WHEN length(crawl_id) % 6 = 0 THEN '<urlset></urlset>' ELSE {entry} END AS body")).unionByName(
        files.selectExpr("'https://' || crawl_id || '/news.xml' AS url", f"{entry} AS body"))
    return S.discover(files, files.select("crawl_id", F.col("crawl_id").alias("primary_host")), docs)


# ---- lab payloads ------------------------------------------------------------------
@query("lab_metrics", "SELECT crawl_id, url, audit_id, score, numeric_value FROM psi")
def lab_metrics(spark, sf):
    """Metrics as service payloads, with an audit nobody asked for."""
    entry = F.struct(F.col("audit_id").alias("k"), F.struct("score", F.col("numeric_value").alias("numericValue")).alias("v"))
    rows = D.psi(spark, sf).select("crawl_id", "url", entry.alias("e"))
    audits = F.map_from_entries(F.array("e", F.struct(F.lit("speed-index").alias("k"), F.col("e.v").alias("v"))))
    payload = F.to_json(F.struct(F.struct(audits.alias("audits")).alias("lighthouseResult")))
    return lab.lab_metrics(rows.select("crawl_id", "url", payload.alias("payload")))


# ---- spider exports ----------------------------------------------------------------
def _export_folder(spark, sf) -> str:
    """The derived crawls as three spider exports of one site."""
    c = D.stored(spark, sf)
    folder = new_path(spark, "exports")
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    writer = lambda df, name: df.write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}.csv")
    internal = c.select(
        F.col("url").alias("Address"), text("status").alias("Status Code"), F.lit("").alias("Indexability"), text("title").alias("Title 1"),
        F.when(F.col("seq") % 4 == 0, "second").otherwise("").alias("Title 2"), text("meta_desc").alias("Meta Description 1"),
        F.coalesce(F.get("h1", F.lit(0)), F.lit("")).alias("H1-1"), F.coalesce(F.get("h1", F.lit(1)), F.lit("")).alias("H1-2"),
        text("canonical").alias("Canonical Link Element 1"), text("meta_robots").alias("Meta Robots 1"), text("depth").alias("Crawl Depth"),
        F.format_number("size", 0).alias("Size (bytes)"), text("download_latency").alias("Response Time"),
        F.coalesce(F.try_element_at("resp_headers", F.lit("content-type")), F.lit("")).alias("Content Type"),
        F.coalesce(F.get("redirects", F.lit(0))["url"], F.lit("")).alias("Redirect URL"))
    links = c.select("url", F.explode("links").alias("l")).select(
        F.lit("Hyperlink").alias("Type"), F.col("url").alias("Source"), F.col("l.url").alias("Destination"), F.lit("a").alias("Anchor"),
        F.when(F.col("l.nofollow"), "false").otherwise("true").alias("Follow"))
    asset = lambda col, kind: c.select("url", F.explode(col).alias("d")).select(
        F.lit(kind).alias("Type"), F.col("url").alias("Source"), F.col("d").alias("Destination"), F.lit("").alias("Anchor"), F.lit("true").alias("Follow"))
    images = c.select("url", F.explode("images").alias("i")).select(
        F.col("url").alias("Address"), F.col("i.src").alias("Image Address"), F.coalesce("i.alt", F.lit("")).alias("Alt Text"))
    writer(internal, "internal_all")
    writer(links.unionByName(asset("script_src", "JavaScript")).unionByName(asset("stylesheet_href", "CSS")), "all_outlinks")
    writer(images, "images_all")
    return folder


@query("import_internal", """SELECT url, status, nullif(trim(title), '') AS title, CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END + CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS title_count,
    nullif(trim(meta_desc), '') AS meta_desc, CASE WHEN trim(coalesce(h1_cell, '')) = '' THEN 0 WHEN h1_cell = 'First@@Second' THEN 2 ELSE 1 END AS h1_items,
    canonical, meta_robots, depth, size, download_latency, content_type FROM crawl""")
def import_internal(spark, sf):
    d = E.import_folder(spark, _export_folder(spark, sf))
    return d.rows.select(
        "url", "status", "title", "title_count", "meta_desc", F.size("h1").cast("bigint").alias("h1_items"), "canonical", "meta_robots", "depth",
        "size", "download_latency", F.try_element_at("resp_headers", F.lit("content-type")).alias("content_type"))


@query("import_edges", """SELECT c.url, count(DISTINCT c.seq) AS pages,
    (SELECT count(*) FROM links l JOIN crawl p ON p.seq = l.seq WHERE p.url = c.url) AS n_links,
    (SELECT count(*) FROM links l JOIN crawl p ON p.seq = l.seq WHERE p.url = c.url AND nofollow) AS n_nofollow,
    (SELECT count(*) FROM scripts l JOIN crawl p ON p.seq = l.seq WHERE p.url = c.url) AS n_scripts,
    (SELECT count(*) FROM styles l JOIN crawl p ON p.seq = l.seq WHERE p.url = c.url) AS n_styles,
    (SELECT count(*) FROM images l JOIN crawl p ON p.seq = l.seq WHERE p.url = c.url) AS n_images
    FROM crawl c GROUP BY c.url""")
def import_edges(spark, sf):
    d = E.import_folder(spark, _export_folder(spark, sf))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    sizes = d.lists.select(
        "url", size("links").alias("n_links"), size(F.filter("links", lambda k: k["nofollow"])).alias("n_nofollow"),
        size("script_src").alias("n_scripts"), size("stylesheet_href").alias("n_styles"), size("images").alias("n_images"))
    counts = ("n_links", "n_nofollow", "n_scripts", "n_styles", "n_images")
    return d.rows.groupBy("url").agg(F.count("*").alias("pages")).join(sizes, "url", "left").select(
        "url", "pages", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


@query("import_signals", """SELECT 'import' AS crawl_id, 'spider-export' AS source, count(*) AS rows, 'internal_all.csv, all_outlinks.csv, images_all.csv' AS files_used,
    'canonical, h1, images, links, meta_desc, meta_robots, multiples, redirect, scripts, title' AS signals FROM crawl""")
def import_signals(spark, sf):
    return E.import_folder(spark, _export_folder(spark, sf)).provenance()


@query("import_audit", f"""SELECT 76 AS num, 'Present' AS status, count_if(trim(title) <> '' AND seq % 4 = 0) AS affected_count FROM crawl
    UNION ALL SELECT 48, 'Present', count_if(status >= 500) FROM crawl
    UNION ALL SELECT 52, 'Not assessed', 0 UNION ALL SELECT 7, 'Not assessed', 0 UNION ALL SELECT 30, 'Not assessed', 0
    UNION ALL SELECT 18, 'Present', count(*) FROM crawl c WHERE EXISTS (SELECT 1 FROM links l JOIN crawl p ON p.seq = l.seq WHERE p.url = c.url AND link LIKE '%utm_%')""")
def import_audit(spark, sf):
    """Verdicts over an imported dataset; checks without their signal stay unassessed."""
    d = E.import_folder(spark, _export_folder(spark, sf))
    run = Audit(d.rows, d.crawls, lists=d.lists)
    return run.checklist().where("num IN (7, 18, 30, 48, 52, 76)").select("num", "status", "affected_count")


@query("own_columns", """SELECT seq, price, "og:title" AS og_title FROM (SELECT seq, CAST(seq AS STRING) || ' EUR' AS price, title AS "og:title" FROM crawl)
    WHERE contains(price, '1') AND "og:title" IS NOT NULL""")
def own_columns(spark, sf):
    """A slice on columns the crawl schema does not name, through files."""
    from siteloom.operators import slicing

    path = new_path(spark, "own-json")
    D.stored(spark, sf).select("crawl_id", "seq", "url", F.concat(F.col("seq").cast("string"), F.lit(" EUR")).alias("price"),
                               F.col("title").alias("og:title")).write.json(path)
    stored = new_path(spark, "own-crawl")
    C.write_crawl(C.read_crawl_json(spark, path, "unused"), stored)
    found = slicing.select_rows(C.read_crawl(spark, stored), ["seq", "price", "og:title"],
                                [{"column": "price", "op": "contains", "value": "1"}, {"column": "og:title", "op": "not_null"}])
    return found.withColumnRenamed("og:title", "og_title")

"""Queries on URL, cell and text expressions, slices and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import cells, urls
from siteloom.functions import constants as K
from siteloom.operators import scope, slicing
from siteloom.testbed import derived as D, duck as Q
from siteloom.testbed.registry import query


def _all_urls(spark, sf):
    """Page, link and canonical URLs of the derived crawl."""
    c = D.stored(spark, sf)
    urls_ = F.concat(F.array("url", "canonical"), F.transform("links", lambda k: k["url"]))
    return c.select("crawl_id", "seq", F.posexplode(F.array_compact(urls_)).alias("i", "u")).select("crawl_id", "seq", "u")


_ALL = """SELECT crawl_id, seq, url AS u FROM crawl UNION ALL SELECT crawl_id, seq, canonical FROM crawl
    WHERE canonical IS NOT NULL UNION ALL SELECT crawl_id, seq, link FROM links"""


@query("url_parts", f"""SELECT crawl_id, seq, u, {Q.scheme('u')} AS scheme, {Q.netloc('u')} AS netloc, {Q.host('u')} AS host,
    regexp_replace({Q.path('u')}, ';[^/]*$', '') AS path, {Q.query('u')} AS query, {Q.fragment('u')} AS fragment,
    coalesce(nullif(lower(regexp_extract(rtrim(regexp_replace({Q.path('u')}, ';[^/]*$', ''), '/'), '[^/.][^/]*([.][^./]+)$', 1)), ''), '(none)') AS suffix,
    lower(split_part(u, '?', 1)) LIKE '%.json' AS is_json
    FROM ({_ALL})""")
def url_parts(spark, sf):
    p = urls.url_parts("u")
    return _all_urls(spark, sf).select(
        "crawl_id", "seq", "u", p["scheme"].alias("scheme"), p["netloc"].alias("netloc"), urls.host("u").alias("host"),
        p["path"].alias("path"), p["query"].alias("query"), p["fragment"].alias("fragment"),
        urls.path_suffix("u").alias("suffix"), urls.has_suffix("u", (".json",)).alias("is_json"))


@query("url_normal_forms", f"""SELECT crawl_id, seq, u, {Q.loose('u')} AS loose, {Q.strict('trim(u)')} AS strict_form,
    {Q.without_query('u')} AS no_query FROM ({_ALL})""")
def url_normal_forms(spark, sf):
    return _all_urls(spark, sf).select(
        "crawl_id", "seq", "u", urls.loose_form("u").alias("loose"), urls.strict_form("u").alias("strict_form"),
        urls.without_query("u").alias("no_query"))


@query("url_param_names", f"""SELECT crawl_id, seq, u, array_to_string(list_sort(list_distinct({Q.params('u')})), ',') AS names,
    {Q.has_param('u', K.FILTER_PARAMS)} AS has_filter, {Q.has_param('u', K.SORT_PARAMS)} AS has_sort,
    {Q.has_param('u', K.SESSION_PARAMS)} AS has_session, {Q.has_param('u', K.PAGINATION_PARAMS)} AS has_page,
    regexp_matches(u, '{Q.SEARCH}', 'i') AS is_search, regexp_matches({Q.netloc('u')}, '{Q.STAGING}', 'i') AS is_staging
    FROM ({_ALL})""")
def url_param_names(spark, sf):
    return _all_urls(spark, sf).select(
        "crawl_id", "seq", "u", F.array_join(F.array_sort(urls.param_names("u")), ",").alias("names"),
        urls.has_param("u", K.FILTER_PARAMS).alias("has_filter"), urls.has_param("u", K.SORT_PARAMS).alias("has_sort"),
        urls.has_param("u", K.SESSION_PARAMS).alias("has_session"),
        urls.has_param("u", K.PAGINATION_PARAMS).alias("has_page"),
        F.col("u").rlike(K.SEARCH_PATH).alias("is_search"), urls.netloc("u").rlike(K.STAGING_HOST).alias("is_staging"))


_RESOLVE = {"rooted": "'/a//b/../c'", "other": "'//cdn.example.com/x'", "absolute": "'https://e.example.org/./a'",
            "query_only": "'?q=2'", "sibling": "'next.html'"}


@query("url_resolve", f"""SELECT seq, url, {Q.scheme('url')} || '://' || {Q.netloc('url')} || '/a//c' AS rooted,
    {Q.scheme('url')} || ':' || '//cdn.example.com/x' AS other, 'https://e.example.org/./a' AS absolute,
    regexp_replace(url, '[?#].*$', '') || '?q=2' AS query_only,
    {Q.scheme('url')} || '://' || {Q.netloc('url')} || CASE WHEN {Q.path('url')} = '' THEN '/' ELSE regexp_replace({Q.path('url')}, '[^/]*$', '') END || 'next.html' AS sibling
    FROM pages_u""", {"pages_u": "SELECT page_id AS seq, url FROM pages"})
def url_resolve(spark, sf):
    p = D.read(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url")
    return p.select("seq", "url", *[urls.resolve("url", F.expr(e)).alias(n) for n, e in _RESOLVE.items()])


def _safe_back(sql: str) -> str:
    for code, char in urls._SAFE.items():
        sql = f"replace({sql}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({sql}, '%2A', '*')"


@query("url_encode_address", f"SELECT crawl_id, seq, {_safe_back('url_encode(u)')} AS encoded FROM ({_ALL})")
def url_encode_address(spark, sf):
    return _all_urls(spark, sf).select("crawl_id", "seq", urls.percent_encode("u").alias("encoded"))


@query("encode_documents", f"SELECT doc_id, length({_safe_back('url_encode(text)')}) AS encoded_chars, "
       f"md5({_safe_back('url_encode(text)')}) AS encoded_md5 FROM documents")
def encode_documents(spark, sf):
    """The percent encoder over whole texts of every script in the corpus."""
    e = urls.percent_encode("text")
    return D.read(spark, sf, "documents").select(
        "doc_id", F.length(e).cast("bigint").alias("encoded_chars"), F.md5(e).alias("encoded_md5"))


@query("word_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(text,
    '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS BIGINT) AS words
    FROM documents""")
def word_counts(spark, sf):
    return D.read(spark, sf, "documents").select("doc_id", cells.word_count("text").alias("words"))


@query("cell_functions", """SELECT crawl_id, seq,
    CASE WHEN h1_cell IS NULL OR h1_cell = '' OR lower(h1_cell) = 'nan' THEN 0 ELSE len(string_split(h1_cell, '@@')) END AS h1_items,
    CASE WHEN h2_cell IS NULL OR h2_cell = '' OR lower(h2_cell) = 'nan' THEN 0 ELSE len(string_split(h2_cell, '@@')) END AS h2_items,
    CASE WHEN h2_cell = '' OR lower(h2_cell) = 'nan' THEN '' ELSE h2_cell END AS h2_clean,
    CAST(trunc(seq / 4.0) AS BIGINT) AS quarter, round(CAST(seq AS DOUBLE) / 7, 4) AS seventh,
    CAST(seq * 1000 AS DOUBLE) AS thousands,
    CASE status WHEN 200 THEN 'OK' WHEN 301 THEN 'Moved Permanently' WHEN 403 THEN 'Forbidden'
        WHEN 404 THEN 'Not Found' WHEN 500 THEN 'Internal Server Error' ELSE '' END AS phrase,
    coalesce(nullif(trim(meta_desc), ''), nullif(trim(title), ''), '') AS best_text,
    coalesce(content_type, '') AS header_value,
    CASE WHEN trim(coalesce(meta_desc, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END AS filled,
    coalesce(content_type LIKE '%html%', false) AS html FROM crawl""")
def cell_functions(spark, sf):
    c = D.flat(spark, sf).withColumn("headers", F.create_map(F.lit("content-type"), F.col("content_type")))
    return c.select(
        "crawl_id", "seq", F.size(cells.split_list("h1_cell")).cast("bigint").alias("h1_items"),
        F.size(cells.split_list("h2_cell")).cast("bigint").alias("h2_items"), cells.clean("h2_cell").alias("h2_clean"),
        cells.to_int((F.col("seq") / 4).cast("string")).alias("quarter"),
        cells.to_float(F.col("seq").cast("double") / 7).alias("seventh"),
        cells.comma_number(F.format_number(F.col("seq") * 1000, 0)).alias("thousands"),
        cells.status_phrase("status").alias("phrase"), cells.first_non_blank("meta_desc", "title").alias("best_text"),
        F.coalesce(cells.header("headers", "Content-Type"), F.lit("")).alias("header_value"),
        cells.count_non_blank("meta_desc", "title").cast("bigint").alias("filled"),
        cells.is_html("headers").alias("html"))


# ---- slices -----------------------------------------------------------------
@query("slice_page", """SELECT url, status, depth, (SELECT count(*) FROM matching) > 20 AS has_more
    FROM (SELECT * FROM matching ORDER BY seq LIMIT 20)""",
       {"matching": "SELECT url, status, depth, seq FROM crawl WHERE status >= 200 AND depth IS NOT NULL AND seq > 10"})
def slice_page(spark, sf):
    """The page of rows that follows the row numbered 10."""
    return slicing.page(
        D.stored(spark, sf), ["url", "status", "depth"],
        [{"column": "status", "op": ">=", "value": 200}, {"column": "depth", "op": "not_null"}], limit=20, after={"seq": 10}, order=("seq",))


_SLICES = {
    "eq": ("l_returnflag", "==", "R", "l_returnflag = 'R'"),
    "ne": ("l_linestatus", "!=", "O", "l_linestatus <> 'O'"),
    "lt": ("l_quantity", "<", 10, "l_quantity < 10"),
    "ge": ("l_discount", ">=", 0.05, "l_discount >= 0.05"),
    "in": ("l_linenumber", "in", [1, 3], "l_linenumber IN (1, 3)"),
    "not_in": ("l_linenumber", "not_in", [2, 7], "NOT coalesce(l_linenumber IN (2, 7), false)"),
    "contains": ("l_orderkey", "contains", "99", "contains(CAST(l_orderkey AS STRING), '99')"),
    "not_null": ("l_tax", "not_null", None, "l_tax IS NOT NULL"),
    "is_null": ("l_tax", "is_null", None, "l_tax IS NULL"),
}


@query("slice_ops", "SELECT " + ", ".join(f"count_if({s[3]}) AS n_{n}" for n, s in _SLICES.items()) + " FROM lineitem")
def slice_ops(spark, sf):
    df = D.read(spark, sf, "lineitem")
    return df.agg(*[
        F.count_if(slicing.condition(df, [{"column": c, "op": op, "value": v}])).alias(f"n_{n}")
        for n, (c, op, v, _) in _SLICES.items()])


@query("slice_filter", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity > 45 AND NOT coalesce(l_linenumber IN (2, 7), false)""")
def slice_filter(spark, sf):
    return slicing.select_rows(
        D.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"],
        [{"column": "l_returnflag", "value": "R"}, {"column": "l_quantity", "op": ">", "value": 45},
         {"column": "l_linenumber", "op": "not_in", "value": [2, 7]}])


@query("slice_nulls", """SELECT crawl_id, seq, status FROM crawl WHERE NOT coalesce(status IN (200, 404), false)
    AND contains(CAST(coalesce(url, '') AS STRING), 'e')""")
def slice_nulls(spark, sf):
    """A null status is in no list and stays."""
    return slicing.select_rows(
        D.stored(spark, sf), ["crawl_id", "seq", "status"],
        [{"column": "status", "op": "not_in", "value": [200, 404]}, {"column": "url", "op": "contains", "value": "e"}])


@query("column_families", "SELECT crawl_id, seq, url, content_type, content_encoding FROM crawl")
def column_families(spark, sf):
    wide = D.flat(spark, sf).withColumnsRenamed({
        "content_type": "resp_headers_content-type", "content_encoding": "resp_headers_content-encoding"})
    return slicing.by_prefix(wide, ["crawl_id", "seq", "url"], ("resp_headers_",)).withColumnsRenamed({
        "resp_headers_content-type": "content_type", "resp_headers_content-encoding": "content_encoding"})


# ---- scope and samples ---------------------------------------------------------
@query("allow_list", f"""SELECT crawl_id, seq, url FROM crawl WHERE {Q.host('url')} IN ('example.org')
    OR {Q.host('url')} LIKE '%.example.org' OR {Q.host('url')} = 'shop.example.com'""")
def allow_list(spark, sf):
    domains = spark.range(1).select(F.explode(urls.literals(["Example.org", "shop.example.com"])).alias("domain"))
    return scope.host_allowed(D.stored(spark, sf).select("crawl_id", "seq", "url"), domains)


@query("scope_filter", f"""SELECT crawl_id, seq, url FROM crawl WHERE ({Q.host('url')} LIKE '%.example.com' OR {Q.host('url')} = 'example.com')
    AND regexp_matches(url, '(list|cat|en)') AND NOT regexp_matches(url, 'feed')
    AND NOT list_has_any({Q.params('url', False)}, ['sort'])""")
def scope_filter(spark, sf):
    return scope.crawl_scope(
        D.stored(spark, sf).select("crawl_id", "seq", "url"), allowed_domains=["example.com"],
        include_url_regex="(list|cat|en)", exclude_url_regex="feed", exclude_url_params=["sort"])


@query("image_scope", """SELECT page_id, img_src, width, height FROM (SELECT page_id, url || '/i.png' AS img_src,
    length(html) % 400 AS width, length(url) % 100 AS height FROM pages) WHERE width >= 100 AND height >= 30 AND regexp_matches(img_src, 'example[.](com|org)')""")
def image_scope(spark, sf):
    images = D.read(spark, sf, "pages").selectExpr(
        "page_id", "url || '/i.png' AS img_src", "CAST(length(html) % 400 AS BIGINT) AS width",
        "CAST(length(url) % 100 AS BIGINT) AS height")
    return scope.image_scope(images, 100, 30, r"example[.](com|org)")


@query("psi_sample", f"""SELECT crawl_id, url, depth, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, seq) AS place
    FROM (SELECT crawl_id, url, min((coalesce(depth, 99), seq))[1] AS depth, min((coalesce(depth, 99), seq))[2] AS seq
    FROM (SELECT crawl_id, url, depth, seq FROM crawl WHERE status = 200 AND content_type LIKE '%html%') GROUP BY crawl_id, url)) WHERE place <= {K.LAB_SAMPLE}""")
def psi_sample(spark, sf):
    return scope.shallow_sample(D.stored(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query("latest_runs", "SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def latest_runs(spark, sf):
    return slicing.newest(D.read(spark, sf, "events"), ["ts", "event_id"], 50).select("event_id", "user_id", "event_type")

"""Queries on the audit: findings by class, checklist, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.plans import asset_checks as A, audit as AU
from siteloom.plans.catalogue import CHECKS, of_kind
from siteloom.plans.report import crawl_detail
from siteloom.testbed import derived as D, duck as Q
from siteloom.testbed.q_analysis import EXTRA
from siteloom.testbed.registry import query

_SHOW = ["crawl_id", "num", "seq", "url"]
_RUNS: dict[tuple[str, str], AU.Audit] = {}


def audit(spark, sf) -> AU.Audit:
    """One audit run per application and data folder, over stored input tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = AU.Audit(
            D.stored(spark, sf), D.crawls(spark, sf), D.robots(spark, sf), D.sitemap(spark, sf),
            D.asset_status(spark, sf), D.asset_body(spark, sf), D.psi(spark, sf), D.render(spark, sf),
            D.flat(spark, sf).select("crawl_id", "seq", "url", "html"))
    return _RUNS[key]


def fresh_audit(spark, sf) -> AU.Audit:
    """A run that shares nothing with earlier ones, so its cost is its own."""
    _RUNS.pop((spark.sparkContext.applicationId, sf), None)
    return audit(spark, sf)


# ---- predicates in SQL --------------------------------------------------------
_H200 = "(coalesce(status = 200, false) AND coalesce(content_type LIKE '%html%', false))"
_CAN = "coalesce(canonical <> '', false)"
_CSCHEME = f"coalesce({Q.scheme('canonical')}, '')"
_BODY = "length(coalesce(body_text, ''))"
_ROB = "lower(coalesce(meta_robots, ''))"


# A crawl that has the top-level key anywhere reads that key on all its pages.
_TYPE = "CASE WHEN EXISTS (SELECT 1 FROM crawl k WHERE k.crawl_id = c.crawl_id AND k.jsonld_type IS NOT NULL) THEN jsonld_type ELSE jsonld_author_type END"


def _in(table: str, cond: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} t WHERE t.seq = c.seq AND ({cond}))"


def _param_canonical(family) -> str:
    return (f"({Q.has_param('url', family)} AND CASE WHEN {_CAN} THEN rtrim(canonical, '/') ELSE '' END "
            f"<> rtrim({Q.without_query('url')}, '/'))")


def _suffix(col: str, suffixes) -> str:
    return "(" + " OR ".join(f"lower(split_part({col}, '?', 1)) LIKE '%{s}'" for s in suffixes) + ")"


_ROW = {
    1: f"{_H200} AND {_BODY} < 50 AND set_cookie IS NOT NULL",
    2: "status IN (401, 403, 429, 503)",
    7: "canonical_total_count > canonical_in_head_count",
    8: f"regexp_matches({Q.netloc('canonical')}, '{Q.STAGING}', 'i')",
    10: _param_canonical(K.FILTER_PARAMS),
    11: _param_canonical(K.SORT_PARAMS),
    12: f"({_CAN} AND (trim(canonical) LIKE '% %' OR {_CSCHEME} = '')) OR canonical_total_count > 1",
    17: Q.has_param("url", K.PAGINATION_PARAMS),
    23: "head_count > 1",
    30: "(jsonld_type IS NOT NULL OR jsonld_author_type IS NOT NULL OR jsonld_context IS NOT NULL) AND "
        f"({_TYPE} IS NULL OR jsonld_context IS NULL)",
    33: "title_count > title_in_head_count",
    34: f"{_H200} AND trim(coalesce(h1_cell, '')) = ''",
    40: f"{_CAN} AND {_CSCHEME} = ''",
    44: f"{_H200} AND NOT regexp_matches(coalesce(content_encoding, ''), 'gzip|br|deflate|zstd')",
    48: "status >= 500 AND status < 600",
    50: f"{Q.scheme('url')} = '' OR {Q.netloc('url')} = '' OR url LIKE '% %'",
    51: "preconnect IS NOT NULL",
    52: f"{_H200} AND NOT (coalesce(viewport, '') LIKE '%width%' AND coalesce(viewport, '') LIKE '%initial-scale%')",
    55: "regexp_matches(coalesce(meta_desc, ''), '<[^>]+>')",
    56: "meta_desc_total_count > 1",
    59: f"{_in('redirects', 'true')} AND status >= 400",
    61: f"{_ROB} LIKE '%nosnippet%'",
    62: f"{_ROB} LIKE '%noarchive%'",
    63: f"{_ROB} LIKE '%noindex%' AND {_CAN}",
    74: "meta_desc_total_count > meta_desc_in_head_count",
    76: "title_count > 1",
    79: f"{_H200} AND trim(coalesce(canonical, '')) = ''",
    83: "lower(split_part(url, '?', 1)) LIKE '%.json'",
}
_LIST = {
    18: _in("links", "lower(link) LIKE '%utm_%'"),
    20: _in("links", f"regexp_matches(link, '{Q.SEARCH}', 'i')"),
    28: f"{_in('scripts', 'in_head')} OR {_in('styles', 'in_head')}",
    29: _in("images", _suffix("src", K.LEGACY_IMAGES)),
    47: _in("styles", "regexp_matches(lower(href), '[.](woff|ttf|otf|eot)$')"),
    49: f"lower(url) LIKE 'https://%' AND ({_in('scripts', 'src LIKE $$http://%$$')} OR {_in('styles', 'href LIKE $$http://%$$')} "
        f"OR {_in('images', 'src LIKE $$http://%$$')} OR {_in('links', 'link LIKE $$http://%$$')})",
    53: _in("images", _suffix("src", (".gif",))),
    60: "(SELECT count(*) FROM redirects t WHERE t.seq = c.seq) + 1 <> (SELECT count(DISTINCT rtrim(u, '/')) FROM "
        "(SELECT c.url AS u UNION ALL SELECT hop FROM redirects t WHERE t.seq = c.seq))",
    64: _in("links", f"NOT nofollow AND {Q.has_param('link', K.FILTER_PARAMS)}"),
    65: _in("links", f"NOT nofollow AND {Q.has_param('link', K.SORT_PARAMS)}"),
    85: f"{_in('images', 'true')} AND NOT {_in('images', _suffix('src', K.MODERN_IMAGES))}",
    89: "(SELECT count(*) FROM scripts t WHERE t.seq = c.seq) <> (SELECT count(DISTINCT split_part(src, '?', 1)) FROM scripts t WHERE t.seq = c.seq)",
}


def _branches(tests: dict[int, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT crawl_id, {n} AS num, seq, url FROM crawl c WHERE {t}" for n, t in tests.items())


# Findings as CTEs: f_<class>(crawl_id, num, basis, rank, seq, pos, url)
def _findings(sql: str, basis: str = "'crawl'") -> str:
    return f"SELECT crawl_id, num, {basis} AS basis, 0 AS rank, seq, 0 AS pos, url FROM ({sql})"


_FALLBACK = of_kind("fallback")
_FILTERS = f"list_sort(list_distinct(list_intersect({Q.params('url')}, {Q.in_list(K.FILTER_PARAMS)})))"
_IMAGES_FIRST = "SELECT crawl_id, src AS url, 0 AS rank, seq, pos FROM images"
_BOTH_FIRST = "SELECT crawl_id, src AS url, 0 AS rank, seq, pos FROM scripts UNION ALL SELECT crawl_id, href, 1, seq, pos FROM styles"


def _ordinal(table: str, cols: str) -> str:
    """List position as the array has it: rank of pos among the rows of the page."""
    return f"SELECT {cols}, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS i FROM {table}"


AUDIT = {
    **EXTRA,
    "f_row": _findings(_branches(_ROW)),
    "f_list": _findings(_branches(_LIST), f"CASE WHEN num IN ({', '.join(map(str, _FALLBACK))}) THEN 'static' ELSE 'crawl' END"),
    "idx": f"""SELECT crawl_id, rtrim(url, '/') AS target,
        max_by(coalesce(status = 200, false) AND NOT ({_ROB} LIKE '%noindex%'), seq) AS ok FROM crawl GROUP BY ALL""",
    "prim": """SELECT crawl_id, host AS primary_host FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id
        ORDER BY pages DESC, first_seq) AS r FROM site_hosts) WHERE r = 1""",
    "f_join": "SELECT crawl_id, num, 'crawl' AS basis, 0 AS rank, seq, 0 AS pos, url FROM (" + f"""
        SELECT c.crawl_id, 6 AS num, seq, url FROM crawl c JOIN idx i ON i.crawl_id = c.crawl_id AND i.target = rtrim(canonical, '/')
            WHERE canonical <> '' AND NOT i.ok
        UNION ALL SELECT crawl_id, unnest(CASE WHEN (SELECT primary_host FROM prim p WHERE p.crawl_id = c.crawl_id) <> '' THEN [9, 24] ELSE [9] END), seq, url
            FROM crawl c WHERE canonical <> '' AND {Q.host('canonical')} <> '' AND NOT EXISTS (
            SELECT 1 FROM site_hosts h WHERE h.crawl_id = c.crawl_id AND h.host = {Q.host('c.canonical')})
        UNION ALL SELECT DISTINCT l.crawl_id, 66, l.seq, l.url FROM link_rows l JOIN idx i ON i.crawl_id = l.crawl_id
            AND i.target = rtrim(l.link, '/') WHERE l.nofollow AND l.internal AND i.ok
        UNION ALL SELECT c.crawl_id, 67, seq, url FROM crawl c JOIN idx i ON i.crawl_id = c.crawl_id AND i.target = rtrim(url, '/')
            WHERE i.ok AND regexp_matches(url, '{Q.SEARCH}', 'i')
        UNION ALL SELECT c.crawl_id, 68, seq, url FROM crawl c JOIN idx i ON i.crawl_id = c.crawl_id AND i.target = rtrim(url, '/')
            WHERE i.ok AND {Q.has_param('url', K.SESSION_PARAMS)}
        UNION ALL SELECT crawl_id, 37, seq, url FROM crawl c WHERE status = 200 AND {_BODY} < 200
            AND EXISTS (SELECT 1 FROM sitemap s WHERE s.crawl_id = c.crawl_id AND s.loc = c.url)
        UNION ALL SELECT s.crawl_id, 91, s.seq, s.loc FROM sitemap s JOIN crawls w ON w.crawl_id = s.crawl_id AND w.is_discovery
            WHERE NOT EXISTS (SELECT 1 FROM crawl c WHERE c.crawl_id = s.crawl_id AND rtrim(c.url, '/') = rtrim(s.loc, '/'))
            AND NOT EXISTS (SELECT 1 FROM links l WHERE l.crawl_id = s.crawl_id AND rtrim(l.link, '/') = rtrim(s.loc, '/')))""",
    "ordered_params": f"""SELECT crawl_id, seq, url, array_to_string({Q.params('url', False)}, chr(1)) AS ord,
        array_to_string({_FILTERS}, ',') AS fam FROM crawl WHERE len({_FILTERS}) >= 2""",
    "variants": f"""SELECT crawl_id, seq, url, rtrim({Q.without_query('url')}, '/') AS base FROM crawl WHERE {Q.query('url')} <> ''""",
    "f_window": f"""SELECT crawl_id, 19 AS num, 'crawl' AS basis, 0 AS rank, seq, 0 AS pos, url FROM (SELECT *, lag(ord) OVER (PARTITION BY crawl_id, fam ORDER BY seq) AS before
            FROM ordered_params) WHERE before <> ord
        UNION ALL SELECT crawl_id, 70, 'crawl', first, seq, 0, url FROM (SELECT *, count(*) OVER (PARTITION BY crawl_id, base) AS n,
            min(seq) OVER (PARTITION BY crawl_id, base) AS first FROM variants) WHERE n > 1
        UNION ALL SELECT crawl_id, 84, 'crawl', 0, min(seq), 0, {Q.without_query('url')} AS base FROM crawl
            WHERE {Q.has_param('url', K.PAGINATION_PARAMS)} GROUP BY crawl_id, base HAVING count(*) > 5""",
    "robots_lines": f"""SELECT crawl_id, robots_url, unnest(t) AS line, generate_subscripts(t, 1) AS line_no FROM (
        SELECT crawl_id, robots_url, string_split(CASE WHEN crawl_id = 'a' THEN '{D.ROBOTS_A}' ELSE '' END, chr(10)) AS t
        FROM crawls WHERE robots_url IS NOT NULL)""",
    "f_site": f"""SELECT crawl_id, num, 'crawl' AS basis, 0 AS rank, seq, 0 AS pos, url FROM (
        SELECT crawl_id, 4 AS num, line_no AS seq, 'line ' || line_no || ': ' || line AS url FROM robots_lines
            WHERE line <> '' AND (line NOT LIKE '%:%' OR lower(trim(split_part(line, ':', 1))) NOT IN ({', '.join(repr(d) for d in K.ROBOTS_DIRECTIVES)}))
        UNION ALL SELECT crawl_id, 5, 0, robots_url FROM robots_lines GROUP BY ALL HAVING string_agg(trim(line), '') = ''
        UNION ALL SELECT crawl_id, 38, 0, robots_url FROM robots_lines GROUP BY ALL HAVING count_if(lower(line) LIKE 'sitemap:%') = 0
        UNION ALL SELECT crawl_id, 31, 0, coalesce(nullif(any_value(primary_host), ''), 'site') FROM crawl JOIN prim USING (crawl_id) GROUP BY crawl_id
            HAVING count(coalesce(jsonld_type, jsonld_author_type)) > 0 AND count_if(coalesce(jsonld_type ILIKE '%organization%', false) OR coalesce(jsonld_author_type ILIKE '%organization%', false)) = 0
        UNION ALL SELECT crawl_id, 32, 0, coalesce(nullif(any_value(primary_host), ''), 'site') FROM crawl JOIN prim USING (crawl_id) GROUP BY crawl_id
            HAVING count(coalesce(jsonld_type, jsonld_author_type)) > 0 AND count_if(coalesce(jsonld_type ILIKE '%localbusiness%', false) OR coalesce(jsonld_author_type ILIKE '%localbusiness%', false)) = 0
        UNION ALL SELECT w.crawl_id, 58, 0, coalesce(any_value(robots_url), 'sitemap') FROM crawls w JOIN sitemap s USING (crawl_id) GROUP BY w.crawl_id HAVING count(*) > 50000
        UNION ALL SELECT w.crawl_id, 77, 0, robots_url FROM crawls w WHERE robots_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sitemap s WHERE s.crawl_id = w.crawl_id)
        UNION ALL SELECT crawl_id, 78, seq, errors FROM sitemap WHERE errors IS NOT NULL)""",
    # Place of an asset in its list counts from 0 over the rows the page has.
    "s_i": _ordinal("scripts", "crawl_id, seq, src AS url"), "y_i": _ordinal("styles", "crawl_id, seq, href AS url"),
    "g_i": _ordinal("images", "crawl_id, seq, src AS url"),
    "uses": """SELECT crawl_id, num, url, min((rank, seq, i))[1] AS rank, min((rank, seq, i))[2] AS seq, min((rank, seq, i))[3] AS pos FROM (
        SELECT crawl_id, unnest([13, 14, 45, 46]) AS num, url, 0 AS rank, seq, i FROM s_i
        UNION ALL SELECT crawl_id, 42, url, 0, seq, i FROM s_i WHERE lower(split_part(url, '?', 1)) LIKE '%.js'
        UNION ALL SELECT crawl_id, unnest([13, 14, 45]), url, 1, seq, i FROM y_i
        UNION ALL SELECT crawl_id, 54, url, 0, seq, i FROM y_i
        UNION ALL SELECT crawl_id, 43, url, 0, seq, i FROM y_i WHERE lower(split_part(url, '?', 1)) LIKE '%.css'
        UNION ALL SELECT crawl_id, unnest([41, 80]), url, 0, seq, i FROM g_i
        UNION ALL SELECT crawl_id, 45, url, 2, seq, i FROM g_i) GROUP BY ALL""",
    "chosen_assets": """SELECT u.*, s.status, b.body, CASE WHEN num IN (13, 41, 45) THEN s.status IS NOT NULL ELSE b.body IS NOT NULL END AS got
        FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, num ORDER BY rank, seq, pos) AS r FROM uses WHERE num NOT IN (14, 80)) u
        LEFT JOIN asset_status s ON s.crawl_id = u.crawl_id AND s.url = u.url LEFT JOIN asset_body b ON b.crawl_id = u.crawl_id AND b.url = u.url""",
    "site_urls": f"""SELECT crawl_id, 39 AS num, trim(substr(line, 9)) AS url, (row_number() OVER (PARTITION BY crawl_id ORDER BY line_no)) - 1 AS pos FROM robots_lines WHERE lower(line) LIKE 'sitemap:%'
        UNION ALL SELECT crawl_id, 82, 'http://' || primary_host || '/', 0 FROM prim WHERE primary_host <> ''
        UNION ALL SELECT crawl_id, 82, CASE WHEN primary_host LIKE 'www.%' THEN 'https://' || substr(primary_host, 5) ELSE 'https://www.' || primary_host END || '/', 1 FROM prim WHERE primary_host <> ''""",
    "site_status": "SELECT u.*, s.status, s.status IS NOT NULL AS got FROM site_urls u LEFT JOIN asset_status s ON s.crawl_id = u.crawl_id AND s.url = u.url",
    "f_asset": f"""SELECT crawl_id, num, 'crawl' AS basis, rank, seq, pos, url FROM (
        SELECT crawl_id, num, rank, seq, pos, url FROM uses WHERE num IN (14, 80) AND crawl_id = 'a'
            AND ({Q.path('url')} LIKE '/img%' OR regexp_matches({Q.path('url')}, '^/assets/.*[.]js'))
        UNION ALL SELECT crawl_id, num, rank, seq, pos, url FROM chosen_assets WHERE num IN (13, 41) AND status >= 400
        UNION ALL SELECT crawl_id, num, rank, seq, pos, url FROM chosen_assets WHERE num IN (42, 43) AND length(body) > 0
            AND (length(body) - length(replace(body, chr(10), ''))) / length(body) > 0.02
        UNION ALL SELECT crawl_id, num, rank, seq, pos, url FROM chosen_assets WHERE num = 46 AND contains(body, 'document.write')
        UNION ALL SELECT crawl_id, num, rank, seq, pos, url FROM chosen_assets WHERE num = 54 AND contains(body, '@import')
        UNION ALL SELECT crawl_id, num, 0, 0, pos, url FROM site_status WHERE (num = 39 AND status >= 400) OR (num = 82 AND status BETWEEN 200 AND 299))""",
    "lab_entries": """SELECT crawl_id, num, p.url, score, numeric_value FROM psi p JOIN (VALUES (25, 'largest-contentful-paint'), (26, 'cumulative-layout-shift'),
        (27, 'uses-responsive-images'), (28, 'render-blocking-resources'), (29, 'uses-optimized-images'), (53, 'efficient-animated-content'),
        (85, 'modern-image-formats'), (87, 'preload-lcp-image'), (88, 'third-party-facades')) v(num, audit_id) USING (audit_id)""",
    # A URL fetched twice has one lab entry.
    "lab_once": "SELECT crawl_id, num, url, min_by((score, numeric_value), 1) AS e FROM lab_entries GROUP BY ALL",
    "first_seen": "SELECT crawl_id, url, min(seq) AS seq FROM crawl GROUP BY ALL",
    "f_lab": """SELECT crawl_id, num, 'lab' AS basis, 0 AS rank, coalesce(seq, 0) AS seq, 0 AS pos, url FROM lab_entries LEFT JOIN first_seen USING (crawl_id, url)
        WHERE CASE WHEN num = 25 THEN coalesce(numeric_value, 0) > 2500 WHEN num = 26 THEN coalesce(numeric_value, 0) > 0.1 ELSE coalesce(score < 0.9, false) END""",
    "static": f"SELECT crawl_id, rtrim(url, '/') AS target, max_by(length(trim(body_text)), seq) AS len, max_by(nav_cell <> '', seq) AS nav FROM crawl GROUP BY ALL",
    "f_render": """SELECT crawl_id, num, 'crawl' AS basis, 0 AS rank, coalesce(seq, 0) AS seq, 0 AS pos, url FROM (
        SELECT r.crawl_id, r.url, unnest(list_filter([CASE WHEN has_errors THEN 15 END, CASE WHEN ok AND nav_link_count > 0 AND NOT nav THEN 16 END,
            CASE WHEN NOT ok OR rendered_text_len < 20 THEN 21 END, CASE WHEN ok AND rendered_text_len > len * 1.5 AND rendered_text_len - len > 500 THEN 22 END,
            CASE WHEN ok AND pseudo_content_count > 0 THEN 35 END, CASE WHEN ok AND overlay THEN 71 END,
            CASE WHEN ok AND title_at_load IS DISTINCT FROM title_after_wait THEN 75 END, CASE WHEN ok AND hidden_text_len >= 200 THEN 90 END], lambda x: x IS NOT NULL)) AS num
        FROM render r LEFT JOIN static s ON s.crawl_id = r.crawl_id AND s.target = rtrim(r.url, '/')) LEFT JOIN first_seen USING (crawl_id, url)""",
    "check_list": "SELECT * FROM (VALUES " + ", ".join(
        f"({c.num}, '{c.title.replace(chr(39), chr(39) * 2)}', '{c.tier}', '{c.kind}', {str(list(c.signals)) if c.signals else '[]::VARCHAR[]'}, {c.heuristic}, '{c.source.replace(chr(39), chr(39) * 2)}')"
        for c in CHECKS.values()) + ") v(num, title, tier, kind, signals, heuristic, source)",
    "grid": """SELECT w.*, k.*, CASE WHEN w.signals IS NULL OR (k.tier = 'CWV' AND has_lighthouse) OR (k.tier = 'RENDER' AND has_render) THEN []
        ELSE list_filter(k.signals, lambda s: NOT list_contains(string_split(w.signals, ','), s)) END AS missing FROM crawls w CROSS JOIN check_list k""",
    "f_every": "SELECT * FROM f_row UNION ALL SELECT * FROM f_list UNION ALL SELECT * FROM f_join UNION ALL SELECT * FROM f_window "
               "UNION ALL SELECT * FROM f_site UNION ALL SELECT * FROM f_asset UNION ALL SELECT * FROM f_lab UNION ALL SELECT * FROM f_render",
    "f_kept": """SELECT * FROM f_every e WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.crawl_id = e.crawl_id AND g.num = e.num AND len(g.missing) > 0)
        AND NOT (basis = 'static' AND EXISTS (SELECT 1 FROM lab_entries l WHERE l.crawl_id = e.crawl_id AND l.num = e.num))""",
    "tallies": "SELECT crawl_id, num, count(*) AS affected, bool_or(basis = 'lab') AS by_lab FROM f_kept GROUP BY ALL",
    "shown": """SELECT crawl_id, num, string_agg(url, chr(10) ORDER BY r) AS example_urls FROM (
        SELECT *, row_number() OVER (PARTITION BY crawl_id, num ORDER BY rank, seq, pos, url) AS r FROM f_kept) WHERE r <= 5 GROUP BY ALL""",
    "samples": """SELECT crawl_id, num, count(*) AS chosen, count_if(got) AS resolved FROM (
        SELECT crawl_id, num, got FROM chosen_assets UNION ALL SELECT crawl_id, num, got FROM site_status) GROUP BY ALL""",
    "judged": """SELECT g.crawl_id, g.num, g.title AS "check", g.tier, g.kind, g.heuristic, g.source, g.missing, coalesce(affected, 0) AS affected, coalesce(by_lab, false) AS by_lab,
        coalesce(example_urls, '') AS example_urls,
        (SELECT count(*) FROM lab_entries l WHERE l.crawl_id = g.crawl_id AND l.num = g.num) > 0 AS has_lab,
        CASE WHEN len(missing) > 0 OR kind = 'fixed' THEN true
          WHEN g.num IN (4, 5, 38, 14, 80) THEN robots_url IS NULL
          WHEN g.num = 77 THEN robots_url IS NULL AND NOT EXISTS (SELECT 1 FROM sitemap s WHERE s.crawl_id = g.crawl_id)
          WHEN g.num IN (37, 58, 78) THEN NOT EXISTS (SELECT 1 FROM sitemap s WHERE s.crawl_id = g.crawl_id)
          WHEN g.num = 91 THEN NOT EXISTS (SELECT 1 FROM sitemap s WHERE s.crawl_id = g.crawl_id) OR NOT coalesce(is_discovery, false)
          WHEN g.num = 39 THEN g.crawl_id <> 'a' OR coalesce(resolved, 0) = 0
          WHEN g.num = 82 THEN coalesce(resolved, 0) = 0
          WHEN kind = 'asset' THEN coalesce(chosen, 0) > 0 AND resolved = 0
          WHEN kind = 'lab' THEN NOT EXISTS (SELECT 1 FROM lab_entries l WHERE l.crawl_id = g.crawl_id AND l.num = g.num)
          WHEN kind = 'render' THEN NOT EXISTS (SELECT 1 FROM render r WHERE r.crawl_id = g.crawl_id)
          ELSE false END AS unassessed
        FROM grid g LEFT JOIN tallies USING (crawl_id, num) LEFT JOIN shown USING (crawl_id, num) LEFT JOIN samples USING (crawl_id, num)""",
    "verdicts": """SELECT *, CASE WHEN unassessed THEN 'Not assessed' WHEN affected = 0 THEN 'Not present'
        WHEN heuristic AND NOT by_lab THEN 'Heuristic' ELSE 'Present' END AS status FROM judged""",
}


def _class(name: str) -> str:
    return f"SELECT crawl_id, num, seq, url FROM {name}"


@query("findings_row", _class("f_row"), AUDIT)
def findings_row(spark, sf):
    return audit(spark, sf).page_findings("row").select(*_SHOW)


@query("findings_list", _class("f_list"), AUDIT)
def findings_list(spark, sf):
    return audit(spark, sf).page_findings("list", "fallback").select(*_SHOW)


@query("findings_join", _class("f_join"), AUDIT)
def findings_join(spark, sf):
    return audit(spark, sf).join_findings().select(*_SHOW)


@query("findings_window", _class("f_window"), AUDIT)
def findings_window(spark, sf):
    return audit(spark, sf).window_findings().select(*_SHOW)


@query("findings_site", _class("f_site"), AUDIT)
def findings_site(spark, sf):
    return audit(spark, sf).site_findings().select(*_SHOW)


@query("findings_asset", "SELECT crawl_id, num, rank, seq, pos, url FROM f_asset", AUDIT)
def findings_asset(spark, sf):
    return audit(spark, sf).asset_findings().select("crawl_id", "num", "rank", "seq", "pos", "url")


@query("findings_lab", "SELECT crawl_id, num, seq, url FROM f_lab", AUDIT)
def findings_lab(spark, sf):
    return audit(spark, sf).lab_findings().select("crawl_id", "num", "seq", "url")


@query("findings_render", "SELECT crawl_id, num, seq, url FROM f_render", AUDIT)
def findings_render(spark, sf):
    return audit(spark, sf).render_findings().select("crawl_id", "num", "seq", "url")


@query("findings_onclick", """SELECT crawl_id, seq, url, true AS resolved, len(list_filter(regexp_extract_all(lower(html), '<a[^>]*onclick='),
    lambda x: NOT contains(x, 'href='))) > 0 AS bad FROM crawl""")
def findings_onclick(spark, sf):
    """Every page tested."""
    html = D.flat(spark, sf).select("crawl_id", "seq", "url", "html")
    return A.onclick_tested(html).select("crawl_id", "seq", "url", "resolved", "bad")


@query("findings", "SELECT crawl_id, num, basis, seq, url FROM f_kept", AUDIT)
def findings(spark, sf):
    return fresh_audit(spark, sf).findings().select("crawl_id", "num", "basis", "seq", "url")


@query("findings_detail", """SELECT crawl_id, f.num, title AS "check", tier, url FROM f_kept f JOIN check_list k ON k.num = f.num""", AUDIT)
def findings_detail(spark, sf):
    return audit(spark, sf).detail().select("crawl_id", "num", "check", "tier", "url")


@query("checklist", """SELECT crawl_id, num, "check", tier, status, affected AS affected_count, example_urls,
    CASE WHEN kind = 'fallback' AND has_lab THEN 'PageSpeed Insights' WHEN len(missing) > 0 THEN 'dataset (field absent)' ELSE source END AS detection_source
    FROM verdicts""", AUDIT)
def checklist(spark, sf):
    return fresh_audit(spark, sf).checklist().drop("explanation", "note")


@query("checklist_full")
def checklist_full(spark, sf):
    """With explanation and note texts."""
    return audit(spark, sf).checklist()


@query("audit_summary", """SELECT tier, status, count(*) AS n FROM verdicts GROUP BY ALL
    UNION ALL SELECT NULL, status, count(*) FROM verdicts GROUP BY ALL""", AUDIT)
def audit_summary(spark, sf):
    return AU.state_counts(audit(spark, sf).checklist())


@query("audit_summary_by_crawl", "SELECT crawl_id, tier, status, count(*) AS n FROM verdicts GROUP BY ALL", AUDIT)
def audit_summary_by_crawl(spark, sf):
    return AU.state_counts_by_crawl(audit(spark, sf).checklist())


@query("audit_gate", "SELECT crawl_id, num, array_to_string(missing, ',') AS missing FROM grid WHERE len(missing) > 0", AUDIT)
def audit_gate(spark, sf):
    return audit(spark, sf).grid().where(F.size("missing") > 0).select(
        "crawl_id", "num", F.array_join("missing", ",").alias("missing"))


# Rows of a crawl's detail that a workbook takes; small enough that every crawl here is cut.
ROWS = 12


@query("embedded_detail", f"""SELECT crawl_id, seq, url AS "Address", n AS rows_in_all FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY seq) AS r,
    count(*) OVER (PARTITION BY crawl_id) AS n FROM crawl) WHERE r <= {ROWS}""")
def embedded_detail(spark, sf):
    return audit(spark, sf).embedded_detail(crawl_detail, ROWS).select("crawl_id", "seq", "Address", "rows_in_all")


@query("audit_configuration", f"""SELECT crawl_id, s[1] AS setting, s[2] AS value FROM (
    SELECT crawl_id, unnest([['audit_url_sample', 'all'], ['Lighthouse (CWV tier)', CASE WHEN has_lighthouse THEN 'enabled' ELSE 'disabled' END],
        ['Headless render (RENDER tier)', CASE WHEN has_render THEN 'enabled' ELSE 'disabled' END], ['GSC / EXTERNAL tier', 'disabled'], ['Backlink source', 'disabled'],
        ['robots.txt fetched', CASE WHEN robots_url IS NULL THEN 'no' ELSE 'yes' END],
        ['sitemap fetched', CASE WHEN EXISTS (SELECT 1 FROM sitemap m WHERE m.crawl_id = w.crawl_id) THEN 'yes' ELSE 'no' END],
        ['PSI URLs assessed', CASE WHEN has_lighthouse THEN CAST((SELECT count(DISTINCT url) FROM lab_entries l WHERE l.crawl_id = w.crawl_id) AS VARCHAR) END],
        ['Render URLs assessed', CASE WHEN has_render THEN CAST((SELECT count(DISTINCT url) FROM render r WHERE r.crawl_id = w.crawl_id) AS VARCHAR) END],
        ['Data source', CASE WHEN signals IS NOT NULL THEN source END], ['Signals available', array_to_string(list_sort(string_split(signals, ',')), ', ')],
        ['URLs in dataset', CASE WHEN signals IS NOT NULL THEN CAST((SELECT count(*) FROM crawl c WHERE c.crawl_id = w.crawl_id) AS VARCHAR) END],
        ['Crawl Detail sheet', CASE WHEN (SELECT count(*) FROM crawl c WHERE c.crawl_id = w.crawl_id) > {ROWS}
            THEN 'first {ROWS} of ' || (SELECT count(*) FROM crawl c WHERE c.crawl_id = w.crawl_id) || ' URLs' END]]) AS s
    FROM (SELECT *, CASE WHEN signals IS NOT NULL THEN 'spider-export' ELSE 'crawl' END AS source FROM crawls) w) WHERE s[2] IS NOT NULL""", AUDIT)
def audit_configuration(spark, sf):
    return audit(spark, sf).configuration(ROWS)

"""Robots files, sitemaps, HTML and spider exports."""

import pytest
from pyspark.sql import functions as F

from siteloom.plans.audit import Audit
from siteloom.sources import html as X, lab, robots as R, sitemap as S, spider_export as E


def test_robots_lines_and_rules(spark):
    body = "User-agent: *\r\nDisallow: /a # why\n\nDisallow:\nDISALLOW : /b*\nUser-agent: x\nDisallow: /c\nnonsense"
    files = spark.createDataFrame([("w", "r", body)], "crawl_id string, robots_url string, body string")
    assert [r.rule for r in R.disallowed(files).orderBy("line_no").collect()] == ["/a", "/b*"]
    assert {r.directive: r.n for r in R.directive_counts(files).collect()} == {"user-agent": 2, "disallow": 4}
    rules = R.rule_arrays(files)
    tried = spark.createDataFrame([("/a/x",), ("/bzz",), ("/c",), ("/.b",)], "p string").join(rules)
    assert {r.p: r.blocked for r in tried.select("p", R.blocked_by(F.col("rules"), "p").alias("blocked")).collect()} == {
        "/a/x": True, "/bzz": True, "/c": False, "/.b": False}


def test_can_fetch(spark):
    body = "User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: *\nDisallow: /*.pdf$\n"
    files = spark.createDataFrame([("h", body)], "host string, body string")
    pages = spark.createDataFrame([("h", "https://h/x/1"), ("h", "https://h/x/ok"), ("h", "https://h/a.pdf"), ("h", "https://h/a.pdf?x"), ("other", "https://o/x")],
                                  "host string, url string")
    got = {(r.url, r.agent): r.can_fetch for r in R.can_fetch(pages, files, ["b", "zed"], ["host"]).collect()}
    assert got == {("https://h/x/1", "b"): False, ("https://h/x/1", "zed"): True, ("https://h/x/ok", "b"): True, ("https://h/x/ok", "zed"): True,
                   ("https://h/a.pdf", "b"): True, ("https://h/a.pdf", "zed"): False, ("https://h/a.pdf?x", "b"): True,
                   ("https://h/a.pdf?x", "zed"): True, ("https://o/x", "b"): True, ("https://o/x", "zed"): True}


def test_sitemap_index_is_followed_once(spark):
    docs = spark.createDataFrame([
        ("root", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>root</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"),
        ("a", "<urlset><url><loc> https://w/?x=1&amp;y=2 </loc><priority>0.5</priority></url></urlset>"), ("gone", "oops")], "url string, body string")
    rows = S.expand(spark.sql("SELECT 'root' AS url"), docs).orderBy("sitemap").collect()
    assert [(r.sitemap, r.loc, r.priority, r.errors) for r in rows] == [
        ("a", "https://w/?x=1&y=2", "0.5", None), ("gone", None, None, "not a sitemap document")]
    assert S.expand(spark.sql("SELECT 'root' AS url"), docs, recursive=False).count() == 0


HTML = """<!DOCTYPE html><html LANG='en'><head><title>One &gt; two</title><!-- <title>no</title> -->
<meta content="d1" name="Description"><link rel="canonical" href='/c'><script>var a = "<h1>x</h1>";</script>
<link href=/p.css rel="preload stylesheet"></head><body class="a>b"><nav><a href="/n">N <b>x</b></a></nav>
<h1>Head <em>line</em></h1><p>Text<br>more</p><title>late</title><link rel=canonical href=/d>
<a title="x>y" href="../up" rel="noopener NOFOLLOW">Up</a><a name=z>no</a><img alt='' src="i.png"></body></html>"""


def test_html_columns(spark):
    page = spark.createDataFrame([("https://w.example/a/b", HTML)], "url string, html string")
    r = X.crawl_columns(page).first()
    assert (r.title, r.meta_desc, r.canonical, r.html_lang, r.h1) == ("One > two", "d1", "/c", "en", ["Head line"])
    assert (r.head_count, r.title_count, r.title_in_head_count) == (1, 2, 1)
    assert (r.canonical_total_count, r.canonical_in_head_count, r.meta_desc_total_count) == (2, 1, 1)
    assert [(k.url, k.text, k.nofollow) for k in r.links] == [("https://w.example/n", "N x", False), ("https://w.example/up", "Up", True)]
    assert r.nav_links_url == ["https://w.example/n"] and r.stylesheet_href == ["/p.css"] == r.preload_href
    assert [(i.src, i.alt) for i in r.images] == [("https://w.example/a/i.png", "")]
    assert r.body_text == "N x Head line Text more late Up no" and r.script_src == []
    with pytest.raises(ValueError):
        X.Pick.of("div > p:nth-child(2)")


def test_caller_selector_wins(spark):
    page = spark.createDataFrame([("u", HTML)], "url string, html string")
    r = X.extract(page, X.merged_selectors({"script_src": "img::attr(src)"})).first()
    assert r.script_src == ["i.png"] and r.html_lang == ["en"]


def test_lab_payload_keeps_known_audits(spark):
    p = '{"lighthouseResult": {"audits": {"largest-contentful-paint": {"score": 0.5, "numericValue": 3.5, "x": 1}, "other": {"score": 1}}}}'
    df = spark.createDataFrame([("w", "u", p), ("w", "v", "broken")], "crawl_id string, url string, payload string")
    assert [tuple(r) for r in lab.lab_metrics(df).collect()] == [("w", "u", "largest-contentful-paint", 0.5, 3.5)]


# ---- spider exports -----------------------------------------------------------
SITE = "https://museum.test"
# One row per rule: heading, description, robots and canonical texts that differ on purpose.
PAGES = """Address,Status Code,Content Type,Title 1,Title 2,Meta Description 1,H1-1,H1-2,Meta Robots 1,Canonical Link Element 1,Crawl Depth,Size (bytes),Redirect URL,Redirect Type
{0}/,200,text/html,Museum,,Opening hours,Welcome,,all,{0}/,0,"12,340",,
{0}/tickets,200,text/html,Tickets,Buy tickets,Prices,Tickets,Groups,all,{0}/tickets,1,900,,
{0}/archive,200,text/html,Archive,,,,,"noindex, noarchive",,2,700,,
{0}/old-tickets,302,,,,,,,,,1,0,{0}/tickets,Temporary
,200,,no address,,,,,,,,,,
""".format(SITE)
EDGES = """Type,Source,Destination,Anchor,Follow
Hyperlink,{0}/,{0}/tickets,"Tickets, please",true
Hyperlink,{0}/,{0}/archive?utm_medium=poster,Archive,no
JavaScript,{0}/,{0}/menu.js,,true
Hyperlink,{0}/tickets,{0}/,Home,true
Hyperlink,,{0}/lost,none,true
""".format(SITE)


def _folder(path, **files):
    for name, text in files.items():
        (path / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode("utf-8-sig"))
    return str(path)


def _pages_by_name(data):
    return {r.url.removeprefix(SITE): r for r in data.crawl.collect()}


def test_pages_and_links_of_an_export(spark, tmp_path):
    data = E.import_folder(spark, _folder(tmp_path, spider_pages=PAGES, spider_links=EDGES, nothing="x,y\n"))
    pages = _pages_by_name(data)
    assert sorted(pages) == ["/", "/archive", "/old-tickets", "/tickets"]
    assert sorted(data.files_used) == ["spider_links.csv", "spider_pages.csv"]
    assert (pages["/"].size, pages["/"].depth, pages["/tickets"].title_count, pages["/tickets"].h1) == (12340, 0, 2, ["Tickets", "Groups"])
    assert [(k.text, k.nofollow) for k in pages["/"].links] == [("Tickets, please", False), ("Archive", True)]
    assert pages["/"].script_src == [f"{SITE}/menu.js"] and pages["/archive"].links == []
    assert (pages["/old-tickets"].redirects[0].url, pages["/archive"].canonical) == (f"{SITE}/tickets", None)


@pytest.mark.parametrize("with_links", [True, False])
def test_signals_decide_what_is_assessed(spark, tmp_path, with_links):
    files = {"spider_pages": PAGES} | ({"spider_links": EDGES} if with_links else {})
    data = E.import_folder(spark, _folder(tmp_path, **files))
    signals = set(data.crawls.first().available_signals)
    assert ("links" in signals) == ("scripts" in signals) == with_links and "viewport" not in signals
    rows = {r.num: r for r in Audit(data.crawl, data.crawls).checklist().collect()}
    # Found in the page rows whatever else is there.
    assert {n: rows[n].affected_count for n in (34, 62, 76, 79)} == {34: 1, 62: 1, 76: 1, 79: 1}
    # Needs links; needs what a spider does not export.
    assert (rows[18].status == "Present") == with_links and (rows[18].status == "Not assessed") != with_links
    assert rows[52].status == rows[33].status == "Not assessed" and "viewport" in rows[52].note


def test_part_files_keep_their_order(spark, tmp_path):
    head, *lines = PAGES.strip().split("\n")
    folder = tmp_path / "spider_pages.csv"
    folder.mkdir()
    for i, line in enumerate(lines[:3]):
        (folder / f"part-{i}.csv").write_text(f"{head}\n{line}\n")
    rows = E.import_folder(spark, str(tmp_path)).crawl.orderBy("seq").collect()
    assert [(r.seq, r.url.removeprefix(SITE)) for r in rows] == [(0, "/"), (1, "/tickets"), (2, "/archive")]


def test_pictures_of_their_own_and_other_encodings(spark, tmp_path):
    pictures = f"Address,Image Address,Alt\n{SITE}/,{SITE}/größe.png,Saal\n".encode("latin-1")
    data = E.import_folder(spark, _folder(tmp_path, spider_pages=PAGES, site_images=pictures))
    assert [tuple(i) for i in _pages_by_name(data)["/"].images] == [(f"{SITE}/größe.png", "Saal")]
    assert "images" in data.crawls.first().available_signals


def test_folders_without_pages_are_refused(spark, tmp_path):
    with pytest.raises(Exception):
        E.import_folder(spark, str(tmp_path))
    with pytest.raises(ValueError):
        E.import_folder(spark, _folder(tmp_path, other="a,b\n1,2\n"))


def test_deep_indexes_and_agents(spark):
    chain = [(f"i{k}", f"<sitemapindex><sitemap><loc>i{k + 1}</loc></sitemap></sitemapindex>") for k in range(14)]
    docs = spark.createDataFrame([*chain, ("i14", "<urlset><url><loc>https://w/last</loc></url></urlset>")], "url string, body string")
    assert [r.loc for r in S.expand(spark.sql("SELECT 'i0' AS url"), docs).collect()] == ["https://w/last"]
    files = spark.createDataFrame([("h", "User-agent: bot\nDisallow: /\nUser-agent: bot-images\nDisallow: /png\n")], "host string, body string")
    pages = spark.createDataFrame([("h", "https://h/jpg/1")], "host string, url string")
    agents = ["Mozilla/5.0 (compatible; Bot/2.1)", "Bot-Images/1.0", "reader"]
    assert {r.agent: r.can_fetch for r in R.can_fetch(pages, files, agents, ["host"]).collect()} == dict(zip(agents, [False, True, True]))


def test_numeric_references_in_sitemaps(spark):
    body = "<urlset><url><loc>https://w/?a=1&#38;b=2&#x26;c=&eacute;&copy=3</loc></url></urlset>"
    r = S.sitemap_urls(spark.createDataFrame([("s", body)], "url string, body string")).first()
    assert r.loc == "https://w/?a=1&b=2&c=é&copy=3"


def test_render_metrics(spark, tmp_path):
    (tmp_path / "r.jl").write_text('{"crawl_id": "k", "url": "u", "ok": true, "rendered_text_len": 12, "rendered_links": ["a"]}\n{"crawl_id": "k", "url": "v", "error": "timeout"}\n')
    rows = lab.read_render_metrics(spark, str(tmp_path)).orderBy("url").collect()
    assert [(r.url, r.ok, r.error, r.rendered_text_len, r.rendered_links, r.overlay) for r in rows] == [("u", True, None, 12, ["a"], None), ("v", False, "timeout", None, None, None)]


def _busy_address(n):
    """An export whose first address stands in n rows, each with links, scripts and pictures of its own."""
    rows = "".join(f"{SITE}/{'busy' if i % 2 else i},200,text/html,T{i}\n" for i in range(2 * n))
    refs = "".join(
        f"Hyperlink,{SITE}/{p},{SITE}/{i}{'?utm_source=x&color=red' if i % 3 == 0 else ''},a,{'true' if i % 2 else 'no'}\nJavaScript,{SITE}/{p},{SITE}/s{i % 3}.js,,true\n"
        for i in range(2 * n) for p in ("busy", i))
    pictures = "".join(f"{SITE}/{'busy' if i % 2 else i},{SITE}/{i}.gif,\n" for i in range(2 * n))
    return {"pages": "Address,Status Code,Content Type,Title 1\n" + rows, "links": "Type,Source,Destination,Anchor,Follow\n" + refs,
            "images": "Address,Image Address,Alt Text\n" + pictures}


def test_rows_of_one_address_share_its_lists(spark, tmp_path):
    data = E.import_folder(spark, _folder(tmp_path, **_busy_address(6)))
    held = data.lists.agg(F.sum(F.size("links")), F.sum(F.size("script_src")), F.sum(F.size("images"))).first()
    # Each reference is stored once, not once for every row of its address.
    assert tuple(held) == (24, 24, 12) and data.rows.agg(F.sum(F.size("links"))).first()[0] == 0
    busy = data.crawl.where(F.col("url").endswith("/busy")).select("links", "script_src", "images").collect()
    assert [(len(r.links), len(r.script_src), len(r.images)) for r in busy] == [(12, 12, 6)] * 6
    # Every row of the address has its findings.
    every, shared = Audit(data.crawl, data.crawls), Audit(data.rows, data.crawls, lists=data.lists)
    found = [sorted(tuple(r) for r in a.findings().collect()) for a in (every, shared)]
    assert found[0] == found[1] and {18, 53, 64, 66, 85, 89} <= {r[1] for r in found[1]}
    assert sum(r[1] == 18 and r[6].endswith("/busy") for r in found[1]) == 6
    assert sorted(map(str, every.checklist().collect())) == sorted(map(str, shared.checklist().collect()))

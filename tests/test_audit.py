"""Check states on small crawls."""

import pytest
from pyspark.sql import functions as F

from siteloom import schema
from siteloom.plans import catalogue
from siteloom.plans.asset_checks import onclick_pages
from siteloom.plans.audit import Audit, state_counts

STATES = {"Present", "Not present", "Heuristic", "Not assessed"}


def _crawl(spark, rows, ddl):
    return schema.conform(spark.createDataFrame(rows, ddl).withColumn("seq", F.monotonically_increasing_id()), "w")


def _run(spark, crawl, **tables):
    info = tables.pop("info", {})
    crawls = spark.sql("SELECT 'w' AS crawl_id")
    for name, (kind, value) in info.items():
        crawls = crawls.withColumn(name, F.lit(value).cast(kind) if not isinstance(value, list) else F.array(*map(F.lit, value)).cast(kind))
    return Audit(crawl, crawls, **tables)


def _states(run):
    return {r.num: r.status for r in run.checklist().collect()}


@pytest.fixture(scope="module")
def toy(spark):
    """A library: its catalogue is open, its reading room is not to be indexed; one has a picture in an old format."""
    lib = "https://library.test"
    return _crawl(spark, [
        (f"{lib}/catalogue", 200, "Q", "All books by author and year", "all", "Books", f"{lib}/catalogue", "Every book has a card. " * 20, "text/html",
         f"{lib}/reading-room@@{lib}/hours", "False@@False", f"{lib}/shelf.png"),
        (f"{lib}/reading-room", 200, "R", "Quiet please", "noindex", "Room", f"{lib}/reading-room", "Silence is kept in here. " * 20, "text/html",
         f"{lib}/catalogue", "False", ""),
    ], "url string, status int, title string, meta_desc string, meta_robots string, h1 string, canonical string, body_text string, "
       "`resp_headers_Content-Type` string, links_url string, links_nofollow string, img_src string")


@pytest.fixture(scope="module")
def toy_run(spark, toy):
    return _run(spark, toy)


def test_without_optional_sources_nothing_is_a_false_pass(toy_run):
    run = toy_run
    states = _states(run)
    assert len(states) == 91 and set(states.values()) <= STATES
    partial = {28, 29, 53, 85, 86}
    for num, c in catalogue.CHECKS.items():
        if c.tier in ("RENDER", "EXTERNAL") or (c.tier == "CWV" and num not in partial):
            assert states[num] == "Not assessed", num
        if num in partial:
            assert states[num] in ("Not assessed", "Not present", "Heuristic"), num
    assert states[29] == "Heuristic" and states[63] == "Present" and states[91] == "Not assessed"
    totals = {r.status: r.n for r in state_counts(run.checklist()).where("tier IS NULL").collect()}
    assert sum(totals.values()) == 91


def test_checklist_counts_equal_findings(toy_run):
    run = toy_run
    found = {r.num: r["count"] for r in run.findings().groupBy("num").count().collect()}
    listed = {r.num: r.affected_count for r in run.checklist().where("affected_count > 0").collect()}
    assert found == listed


def test_signal_gate_names_what_is_missing(spark, toy):
    run = _run(spark, toy, info={"available_signals": ("array<string>", ["title", "canonical"]), "source": ("string", "spider-export")})
    row = run.checklist().where("num = 52").first()
    assert row.status == "Not assessed" and "viewport" in row.note and "spider-export" in row.note
    assert run.findings().where("num IN (44, 52)").isEmpty()


@pytest.mark.parametrize("listed, discovery, orphans", [
    (["map", "tours"], True, None), (["map", "cellar"], True, ["cellar"]), (["map/", "tours#x"], True, ["tours#x"]),
    (["cellar"], False, "unassessed"), (["cellar"], None, "unassessed"), ([], True, "unassessed")])
def test_orphans(spark, listed, discovery, orphans):
    """A zoo whose start page links the map, and the map the tours; the cellar is linked by nobody."""
    zoo = "https://zoo.test/"
    crawl = _crawl(spark, [(zoo, 200, zoo + "map"), (zoo + "map", 200, zoo + "tours")], "url string, status int, links_url string")
    sitemap = spark.createDataFrame([("w", i, zoo + p, None) for i, p in enumerate(listed)], "crawl_id string, seq bigint, loc string, errors string")
    row = _run(spark, crawl, sitemap=sitemap, info={"is_discovery": ("boolean", discovery)}).checklist().where("num = 91").first()
    if orphans == "unassessed":
        assert row.status == "Not assessed" and row.note
    else:
        assert row.status == ("Present" if orphans else "Not present")
        assert row.example_urls == "\n".join(zoo + p for p in orphans or [])


# What a render of a healthy page reports, and what changes when one thing goes wrong.
HEALTHY = {"ok": True, "page_errors": [], "title_at_load": "Opera", "title_after_wait": "Opera", "rendered_text_len": 640, "nav_link_count": 0,
           "hidden_text_len": 12, "pseudo_content_count": 0, "overlay": False}
SYMPTOMS = [
    ({}, {}, []),
    ({"page_errors": ["x is not defined", "again"]}, {}, [15]),
    ({"nav_link_count": 7}, {}, [16]),
    ({"nav_link_count": 7}, {"nav_links_url": "https://opera.test/cast"}, []),
    ({"rendered_text_len": 19}, {}, [21]),
    ({"rendered_text_len": 5000}, {}, [22]),
    ({"rendered_text_len": 1100}, {}, []),
    ({"pseudo_content_count": 1, "overlay": True}, {}, [35, 71]),
    ({"title_after_wait": None, "hidden_text_len": 200}, {}, [75, 90]),
    ({"ok": False, "overlay": True, "hidden_text_len": 900}, {}, [21]),
]


@pytest.mark.parametrize("changed, static, found", SYMPTOMS)
def test_render_checks(spark, changed, static, found):
    page = {"url": "https://opera.test/", "status": 200, "body_text": "o" * 640, "nav_links_url": ""} | static
    crawl = _crawl(spark, [tuple(page.values())], "url string, status int, body_text string, nav_links_url string")
    ddl = ("crawl_id string, url string, ok boolean, page_errors array<string>, title_at_load string, title_after_wait string, rendered_text_len bigint, "
           "nav_link_count bigint, hidden_text_len bigint, pseudo_content_count bigint, overlay boolean")
    render = spark.createDataFrame([("w", page["url"], *(HEALTHY | changed).values())], ddl)
    run = _run(spark, crawl, render=render, info={"has_render": ("boolean", True)})
    assert sorted(r.num for r in run.render_findings().collect()) == found


def test_assets_beyond_any_sample(spark):
    """Every supplied status counts, and an address listed twice counts once."""
    crawl = _crawl(spark, [("https://m.test/", 200, "@@".join(f"https://m.test/s{i}.js" for i in range(300)))], "url string, status int, script_src string")
    statuses = spark.createDataFrame([("w", f"https://m.test/s{i}.js", s) for i in range(300) for s in (200, 500)], "crawl_id string, url string, status bigint")
    row = _run(spark, crawl, asset_status=statuses).checklist().where("num = 13").first()
    assert (row.status, row.affected_count) == ("Present", 300)


def test_lab_checks(spark, toy):
    psi = spark.createDataFrame([
        ("w", "https://w.example/a", "largest-contentful-paint", 0.2, 4000.0), ("w", "https://w.example/b", "largest-contentful-paint", 0.9, 1000.0),
        ("w", "https://w.example/a", "uses-optimized-images", 1.0, None), ("w", "https://w.example/a", "preload-lcp-image", 0.1, None),
        ("w", "https://w.example/a", "prioritize-lcp-image", 1.0, None)], "crawl_id string, url string, audit_id string, score double, numeric_value double")
    rows = {r.num: r for r in _run(spark, toy, psi=psi, info={"has_lighthouse": ("boolean", True)}).checklist().collect()}
    assert rows[25].status == "Present" and rows[25].affected_count == 1
    assert rows[26].status == "Not assessed"
    assert rows[29].status == "Not present" and rows[29].detection_source == "PageSpeed Insights"
    assert rows[87].status == "Not present"
    assert rows[85].status == "Heuristic"


def test_onclick_anchors(spark):
    html = spark.createDataFrame([("w", 1, "u1", "<a onclick='x()'>y</a>"), ("w", 2, "u2", "<A href='/' onclick='x()'>y</A>"), ("w", 3, "u3", None)],
                                 "crawl_id string, seq bigint, url string, html string")
    assert {r.url: (r.resolved, r.bad) for r in onclick_pages(html).collect()} == {
        "u1": (True, True), "u2": (True, False), "u3": (False, None)}


def test_pages_are_searched_once(spark, toy):
    """Findings and verdicts read one table of searched pages."""
    html = spark.createDataFrame([("w", 0, "u1", "<a onclick='x()'>y</a>")], "crawl_id string, seq bigint, url string, html string")
    run = _run(spark, toy, html=html)
    rows = run.checklist()
    assert "onclick=" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.num: r.affected_count for r in rows.collect()}[81] == 1


def test_own_check(spark, toy):
    own = catalogue.with_row_check(catalogue.CHECKS, 900, "Short title", lambda: F.length("title") < 2)
    run = _run(spark, toy, checks=own)
    row = run.checklist().where("num = 900").first()
    assert (row.status, row.affected_count) == ("Present", 2)
    with pytest.raises(ValueError):
        catalogue.with_row_check(own, 1, "taken", lambda: F.lit(True))


def test_a_failing_check_does_not_end_the_run(spark, toy):
    own = catalogue.with_row_check(catalogue.CHECKS, 901, "Breaks", lambda: F.raise_error(F.lit("no")).isNull())
    rows = {r.num: r for r in _run(spark, toy, checks=own).checklist().where("num IN (63, 901)").collect()}
    assert rows[901].status == "Not assessed" and "failed" in rows[901].note
    assert rows[63].status == "Present"


def test_duplicate_fetch_last_one_decides(spark):
    crawl = schema.conform(spark.createDataFrame(
        [("w", 1, "https://w.example/t", 404, None), ("w", 2, "https://w.example/t/", 200, None), ("w", 3, "https://w.example/p", 200, "https://w.example/t")],
        "crawl_id string, seq bigint, url string, status int, canonical string"))
    assert _run(spark, crawl).join_findings().where("num = 6").isEmpty()


def test_notes_say_what_was_there(spark, toy):
    sitemap = spark.createDataFrame([("w", i, f"https://library.test/{i}", None) for i in range(3)], "crawl_id string, seq bigint, loc string, errors string")
    notes = {r.num: r.note for r in _run(spark, toy, sitemap=sitemap).checklist().collect()}
    assert notes[58] == "The sitemap lists 3 URL(s)." and notes[86].startswith("0 page(s)")
    assert notes[30] == notes[31] == "No page carries JSON-LD." and notes[13] == "The crawl names no script or stylesheet."
    assert notes[17] == notes[1] == ""

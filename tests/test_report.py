"""The detail report on a shop of four pages."""

import pytest

from siteloom import schema
from siteloom.functions.constants import DETAIL_COLUMNS
from siteloom.plans.report import crawl_detail, detail_totals

SHOP = "https://shop.test"
PAGES = [
    # A product: two headings, an own and a foreign link, three pictures of which one has a text.
    dict(url=f"{SHOP}/kettle", status="200", title="Kettle, 1.7 litres", meta_robots="all", h1="Kettle@@Reviews", h2="Size", canonical="/kettle",
         body_text="boils water fast and quietly", size=400, depth=2, links_url=f"{SHOP}/basket@@https://maker.test/kettle@@{SHOP}/basket",
         links_nofollow="False@@True@@False", img_src="k1.png@@k2.png@@k3.png", img_alt="front@@@@", hreflang_hreflang="pl", jsonld="Product"),
    # A basket kept out of the index, linked twice from one page.
    dict(url=f"{SHOP}/basket", status="200", title="Basket", meta_robots="NoIndex", canonical=f"{SHOP}/basket", body_text="", size=80, depth=1,
         links_url=f"{SHOP}/kettle", links_nofollow="False"),
    # A page that names another one as the original.
    dict(url=f"{SHOP}/kettle?colour=red", status="200", title="Kettle", canonical=f"{SHOP}/kettle", body_text="red", size=60, depth=3),
    dict(url=f"{SHOP}/gone", status="410", title="Gone", size=20, depth=1),
]
TEXT = ["url", "status", "title", "meta_robots", "h1", "h2", "canonical", "body_text", "links_url", "links_nofollow", "img_src", "img_alt", "hreflang_hreflang"]


@pytest.fixture(scope="module")
def report(spark):
    rows = [tuple(p.get(c, "") for c in TEXT) + (p["size"], p["depth"], p.get("jsonld", "")) for p in PAGES]
    ddl = ", ".join(f"{c} string" for c in TEXT) + ", size int, depth int, `jsonld_@type` string"
    return crawl_detail(schema.conform(spark.createDataFrame(rows, ddl), "shop"))


@pytest.fixture(scope="module")
def rows(report):
    return {r["Address"].removeprefix(SHOP): r for r in report.collect()}


def test_columns_and_totals(report):
    assert tuple(report.columns[2:]) == DETAIL_COLUMNS
    totals = detail_totals(report).first()
    assert (totals.rows, totals.indexable_urls, totals.non_indexable_urls) == (4, 1, 3)


@pytest.mark.parametrize("page, indexable, canonical_is_self", [
    ("/kettle", "Indexable", True), ("/basket", "Non-Indexable", True), ("/kettle?colour=red", "Non-Indexable", False), ("/gone", "Non-Indexable", None)])
def test_verdict_per_page(rows, page, indexable, canonical_is_self):
    assert rows[page]["Indexability"] == indexable
    if canonical_is_self is not None:
        assert rows[page]["Canonical Is Self"] is canonical_is_self


def test_links_are_counted_from_both_ends(rows):
    kettle, basket = rows["/kettle"], rows["/basket"]
    assert (kettle["Outlinks"], kettle["Unique Outlinks"], kettle["External Outlinks"]) == (3, 2, 1)
    assert (basket["Inlinks"], basket["Unique Inlinks"]) == (2, 1)
    assert (kettle["Inlinks"], rows["/gone"]["Inlinks"]) == (1, 0)


def test_lists_and_sizes(rows):
    kettle = rows["/kettle"]
    assert [kettle[c] for c in ("H1-1", "H1-2", "H1 Count", "H2-1", "H2-2")] == ["Kettle", "Reviews", 2, "Size", ""]
    assert (kettle["Images"], kettle["Images Missing Alt Text"]) == (3, 2)
    assert (kettle["Word Count"], kettle["Text Ratio"]) == (5, 7.0)
    assert (kettle["Title 1 Length"], kettle["URL Length"]) == (18, 24)
    assert (kettle["Structured Data Types"], kettle["Hreflang Count"]) == ("Product", 1)

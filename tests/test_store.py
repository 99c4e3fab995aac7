"""One store for many crawls, and crawler output that was cut."""

import json

import pytest
from pyspark.sql import functions as F

from siteloom import schema
from siteloom.operators import slicing
from siteloom.sources import crawl as C, robots, sitemap


def lines(path, *rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    return str(path)


def test_crawls_with_columns_of_their_own(spark, tmp_path):
    store = str(tmp_path / "store")
    one = C.read_crawl_json(spark, lines(tmp_path / "a.jl", {"url": "https://a/", "status": 200, "price": "9"}), "one")
    two = C.read_crawl_json(spark, lines(tmp_path / "b.jl", {"url": "https://b/", "status": 404, "og:title": "t"}, {"url": "https://b/2", "status": 200}), "two")
    assert C.write_crawl(one, store) and C.write_crawl(two, store)
    both = C.read_crawl(spark, store)
    got = {r.url: (r.crawl_id, r.price, r["og:title"]) for r in slicing.page(both, ["crawl_id", "url", "price", "og:title"], [], limit=10).collect()}
    assert got == {"https://a/": ("one", "9", None), "https://b/": ("two", None, "t"), "https://b/2": ("two", None, None)}
    # Replaced as a whole; the other crawl stays.
    again = C.read_crawl_json(spark, lines(tmp_path / "c.jl", {"url": "https://b/new", "status": 200, "sku": "1"}), "two")
    assert C.write_crawl(again, store)
    both = C.read_crawl(spark, store)
    assert {(r.crawl_id, r.url, r.price, r.sku) for r in both.collect()} == {("one", "https://a/", "9", None), ("two", "https://b/new", None, "1")}
    assert [f.name for f in both.schema][:len(schema.CRAWL)] == schema.CRAWL.names
    # An empty crawl replaces nothing, and a filter on the crawl reads its folder alone.
    assert not C.write_crawl(again.limit(0), store) and C.read_crawl(spark, store).count() == 2
    files = both.where("crawl_id = 'one'").select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "crawl_id=one" in files[0][0]


def test_two_crawls_in_one_write(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("x", 1, "https://x/"), ("y", 1, "https://y/"), ("z", 1, "https://z/")]
    C.write_crawl(schema.conform(spark.createDataFrame(rows, "crawl_id string, seq bigint, url string")), store)
    C.write_crawl(schema.conform(spark.createDataFrame([("x", 1, "https://x/n"), ("z", 1, "https://z/n")], "crawl_id string, seq bigint, url string")), store)
    assert {r.url for r in C.read_crawl(spark, store).collect()} == {"https://x/n", "https://y/", "https://z/n"}


@pytest.mark.parametrize("typed", [False, True])
def test_cut_lines_give_no_row(spark, tmp_path, typed):
    path = lines(tmp_path / "a.jl", {"url": "https://a/1", "status": 200}, {"url": "https://a/2", "status": 200}, tail='not json\n{"url": "https://a/3", "sta')
    columns = C.T.StructType([C.T.StructField("url", C.T.StringType()), C.T.StructField("status", C.T.StringType())]) if typed else None
    crawl = C.read_crawl_json(spark, path, "k", columns)
    assert sorted((r.url, r.seq) for r in crawl.collect()) == [("https://a/1", 0), ("https://a/2", 1)]
    assert not any(c.startswith("_") for c in crawl.columns)
    bad = C.rejected_lines(spark, path, "k").orderBy("place").collect()
    assert [(r.place, r.raw, r.reason) for r in bad] == [(2, "not json", "not a JSON object"), (3, '{"url": "https://a/3", "sta', "cut line")]
    assert bad[0].file.endswith("a.jl")


def test_sound_output_has_no_rejects(spark, tmp_path):
    path = lines(tmp_path / "a.jl", {"url": "https://a/1"})
    assert C.rejected_lines(spark, path, "k").count() == 0 and C.read_crawl_json(spark, path, "k").count() == 1


def test_side_tables(spark, tmp_path):
    df = spark.range(3)
    assert C.write_side_table(df, str(tmp_path / "s")) and spark.read.parquet(str(tmp_path / "s")).count() == 3
    assert C.write_side_table(df.limit(0), str(tmp_path / "e")) is None


def test_files_that_are_no_robots_file(spark):
    bodies = {"gone": None, "page": "﻿\n<html><p>Disallow: /x</p>", "bin": "User-agent: *\0", "odd": "hello: there\n#disallow: x", "words": "not here",
              "blank": " \n\n", "notes": "# only\n  # notes", "ok": "x: y\r\n  DISALLOW : /x", "map": "Sitemap: https://w/s.xml"}
    files = spark.createDataFrame([("c", k, b) for k, b in bodies.items()], "crawl_id string, robots_url string, body string")
    bad = robots.rejected_files(files)
    assert bad.columns == ["crawl_id", "robots_url", "raw", "reason"]
    assert {r.robots_url: (r.raw, r.reason) for r in bad.collect()} == {
        k: (bodies[k], why) for k, why in {"gone": "no body", "page": "markup", "bin": "binary content", "odd": "no known directive", "words": "no known directive"}.items()}
    assert robots.rejected_files(files.limit(0)).count() == 0


def test_documents_that_are_no_sitemap(spark):
    bodies = {"gone": None, "page": "<html>", "cut": "<urlset><url><loc>a</loc></url><url><loc>b", "empty": "<urlset/>", "ok": "<URLSET><url><loc>a</loc></url></URLSET>",
              "bare": "<urlset><url><loc>a</loc></url><url><lastmod>1</lastmod></url></urlset>", "index": "<sitemapindex><sitemap><loc></loc></sitemap></sitemapindex>",
              "hidden": "<!-- <urlset> -->"}
    docs = spark.createDataFrame([(k, b) for k, b in bodies.items()], "url string, body string")
    got = sorted((r.sitemap, r.place, r.raw, r.reason) for r in sitemap.rejected_documents(docs).collect())
    assert got == [
        ("bare", 1, "<lastmod>1</lastmod>", "entry without an address"), ("cut", None, bodies["cut"], "cut document"), ("gone", None, None, "no body"),
        ("hidden", None, bodies["hidden"], "not a sitemap document"), ("index", 0, "<loc></loc>", "entry without an address"),
        ("page", None, "<html>", "not a sitemap document")]
    # The whole entries of a cut document count.
    assert [r.loc for r in sitemap.sitemap_urls(docs.where("url = 'cut'")).collect()] == ["a"]

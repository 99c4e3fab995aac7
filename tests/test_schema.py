"""Flat crawler output to the crawl schema, and cell helpers."""

import json

from pyspark.sql import functions as F

from siteloom import schema
from siteloom.functions import cells
from siteloom.sources import crawl as C


def test_conform_folds_lists_headers_and_markup(spark):
    df = spark.createDataFrame(
        [("https://s/", "200.0", "A@@B", "x@@y", "True", "i.png@@j.png", "alt", "text/html", "nan", "Product")],
        "url string, status string, h1 string, links_url string, links_nofollow string, img_src string, img_alt string, "
        "`resp_headers_Content-Type` string, resp_headers_Server string, `jsonld_@type` string")
    r = schema.conform(df, "one").first()
    assert (r.crawl_id, r.status, r.h1) == ("one", 200, ["A", "B"])
    assert [(k.url, k.nofollow) for k in r.links] == [("x", True), ("y", False)]
    assert [(i.src, i.alt) for i in r.images] == [("i.png", "alt"), ("j.png", None)]
    assert r.resp_headers == {"content-type": "text/html"} and r.jsonld == {"@type": "Product"}
    assert r.title is None and r.script_src == [] and r.depth is None


def test_conform_is_stable_on_typed_input(spark):
    once = schema.conform(spark.createDataFrame([("u", 1)], "url string, depth int"))
    assert schema.conform(once).dtypes == once.dtypes
    assert [n for n, _ in once.dtypes] == schema.CRAWL.names
    assert [f.dataType.simpleString() for f in schema.CRAWL] == [t for _, t in once.dtypes]


def test_cells(spark):
    df = spark.createDataFrame([("a@@@@b", " 1,234.5 ", "12.9", " a\tb  c\x1cd"), ("", "x", "inf?", None), ("NaN", "", None, "")],
                               "l string, n string, i string, t string")
    rows = df.select(cells.split_list("l"), cells.comma_number("n"), cells.to_int("i"), cells.word_count("t")).collect()
    assert [tuple(r) for r in rows] == [(["a", "", "b"], 1234.5, 12, 4), ([], None, None, 0), ([], None, None, 0)]
    assert spark.range(1).select(cells.status_phrase(F.lit(404)), cells.status_phrase(F.lit(999))).first()[:] == ("Not Found", "")


def test_json_lines_and_image_shards(spark, tmp_path):
    (tmp_path / "c.jl").write_text("\n".join(json.dumps(x) for x in [
        {"url": "https://s/a", "status": 200, "resp_headers_X": "1"}, {"url": "https://s/b", "status": 404, "jsonld_@type": "Org"}]))
    df = C.read_crawl_json(spark, str(tmp_path / "c.jl"), "k")
    assert [(r.url, r.status) for r in df.orderBy("url").collect()] == [("https://s/a", 200), ("https://s/b", 404)]
    assert C.write_crawl(df.where("false"), str(tmp_path / "none")) is False
    assert C.write_crawl(df, str(tmp_path / "out")) and C.read_crawl(spark, str(tmp_path / "out")).count() == 2

    shards = tmp_path / "shards"
    shards.mkdir()
    (shards / "0.jl").write_text('{"img_src": "a.png", "width": 10, "height": 10}\n{"img_src": "b.gif", "width": 90, "height": 90}')
    (shards / "1.jl").write_text("")
    assert [r.img_src for r in C.read_image_shards(spark, str(shards), 50, 50, "gif$").collect()] == ["b.gif"]

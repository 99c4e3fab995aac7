"""Character references, base addresses and structured data of stored pages."""

import html
import json
import random

from pyspark.sql import functions as F

from siteloom import schema
from siteloom.functions.references import decoded
from siteloom.plans.site_checks import markup_types
from siteloom.session import materialise
from siteloom.sources import html as X, markup as M

TEXTS = ["a &amp; b", "&eacute;&Eacute", "&#38;&#x41;&#0;&#128;&#xD800;&#x110000;&#9999999999999;", "&notit; &notin; &copy2 &copy;", "&&&", "&unknown; &amp",
         "x&lt", "", "no", "&#;&#x;&#x;", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&#0000000065;z", "&ampamp;", "&amp;lt;", "🙂&hearts;&#128512;"]


def test_references_as_the_standard_reads_them(spark):
    rnd = random.Random(4)
    names = sorted(html.entities.html5)
    more = ["".join(rnd.choice(["&", "#", "x", "65", ";", " ", "amp", rnd.choice(names)]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in TEXTS + more + ["&" + n for n in names[::9]]], "t string")
    assert [(r.t, r.d) for r in df.select("t", decoded("t").alias("d")).collect() if r.d != html.unescape(r.t)] == []
    assert spark.createDataFrame([(None,)], "t string").select(decoded("t").alias("d")).first().d is None


def test_parameters_in_addresses_stay(spark):
    cases = {"?a=1&copy=2": "?a=1&copy=2", "?a&copyx": "?a&copyx", "?a&copy": "?a©", "?a&amp;copy=2": "?a&copy=2", "?lt&lt;=1": "?lt<=1"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", decoded("t", in_attribute=True).alias("d")).collect()} == cases


def test_base_address(spark):
    pages = [
        ("https://w.test/a/b", "<a href='x?a=1&amp;b=2'>1</a>"), ("https://w.test/a/b", "<base target=_top><base href='/c/'><base href='/no/'><a href=x>1</a>"),
        ("https://w.test/a/b", "<base href='https://cdn.test/r/s'><a href='../x'>1</a><img src=i.png>"), ("https://w.test/a/b", "<base href=' '><a href='#f'>1</a>")]
    got = X.crawl_columns(spark.createDataFrame(pages, "url string, html string")).collect()
    assert [r.links[0].url for r in got] == ["https://w.test/a/x?a=1&b=2", "https://w.test/c/x", "https://cdn.test/x", "https://w.test/a/b#f"]
    assert got[2].images[0].src == "https://cdn.test/r/i.png"


def script(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def test_markup_of_many_shapes(spark):
    deep = "end"
    for _ in range(30):
        deep = {"d": [deep]}
    cases = [
        ("", {}), (None, {}), (script(""), {"errors": "not JSON"}), (script([]), {}), (script({}), {}), (script("7"), {}),
        (script({"@type": ["A", "B"], "x": None, "n": {"@type": "C", "l": [1, 2.5, True, {"@type": "D"}]}}), {"@type": "A@@B", "n.@type": "C", "n.l": "1@@2.5@@true", "n.l.@type": "D"}),
        (script([{"@type": "A"}, {"@type": "B", "q": 'say "]}" <b>'}]), {"@type": "A@@B", "q": 'say "]}" <b>'}),
        (script({"a": 1}) + script("{") + script({"a": 2}), {"a": "1", "1_errors": "not JSON", "2_a": "2"}),
        (script(deep), {".".join("d" * 30): "end"}), ("<script>" + json.dumps({"@type": "No"}) + "</script><!--" + script({"@type": "No"}) + "-->", {})]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    got = {r.i: r.m for r in df.select("i", M.jsonld("h").alias("m")).collect()}
    assert got == {i: m for i, (_, m) in enumerate(cases)}


def test_checks_see_every_block(spark):
    """Organization stands in a list of a nested object of a second block."""
    pages = [("https://w.test/", script({"@context": "c", "@type": "Article"}) + script({"@graph": [{"publisher": {"@type": ["Organization"]}}]}))]
    crawl = materialise(schema.conform(X.crawl_columns(spark.createDataFrame(pages, "url string, html string")).drop("html"), "k"), "crawl")
    primaries = spark.createDataFrame([("k", "w.test")], "crawl_id string, primary_host string")
    assert [r.num for r in markup_types(crawl, primaries).select("num").collect()] == [32]


def test_open_graph(spark):
    page = '<meta property="og:title" content="a &amp; b"><meta property=OG:image content=1><meta property=og:image content=2><meta name="twitter:card" content=s><meta name=other content=x>'
    r = X.crawl_columns(spark.createDataFrame([("https://w.test/", page)], "url string, html string")).first()
    assert r.og == {"og:title": "a & b", "og:image": "1@@2", "twitter:card": "s"}


def test_blocks_are_parsed_once(spark):
    """However many paths they hold: the parser stood in the lambda that is called for each path."""
    df = spark.createDataFrame([('<script type="application/ld+json">{"@type":"A","b":["1","2"],"c":{"d":3}}</script>',)], "html string")
    out = df.select(M.jsonld("html").alias("m"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("parse_json") == 1 and plan.count("regexp_extract_all(coalesce") == 1
    assert out.first().m == {"@type": "A", "b": "1@@2", "c.d": "3"}

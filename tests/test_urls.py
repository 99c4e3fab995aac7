"""URL expressions against the Python standard library."""

import random
from urllib.parse import parse_qs, quote, urljoin, urlsplit, urlparse

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls

URLS = [
    "https://S.Example.com/a/b/?x=1&y=2#top", "http://user:pw@h.example.com:8080/a;v=1/b;w=2?q", "https://h.example.com",
    "https://h.example.com/", "https://h.example.com//", "HTTPS://H.EXAMPLE.COM/A//", "/rel/path?z=1", "rel", "mailto:a@b.example",
    "//cdn.example.com/x.js", "broken url 7", "https://bad host.example.com/", "https://h_x.example.com/?a=&b=1&c&A=2&=3",
    "https://h.example.com/?na%20me=1&pl+us=2&%zz=3", "https://h.example.com/p?q=a/b?c#d?e#f", "1http://x", "https://h.example.com/ü?ö=ß",
    "https://h.example.com?only=query", "https://h.example.com#frag", "a:b", "?q=1", "#f", "https://h.example.com/a/./b/../c",
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, u string").cache()


def _collect(table, col):
    return [r[0] for r in table.orderBy("i").select(col).collect()]


def test_parts_match_standard_library(table):
    got = _collect(table, urls.url_parts("u"))
    for u, p in zip(URLS, got):
        want = urlsplit(u)
        assert (p.scheme, p.netloc, p.query, p.fragment) == (want.scheme, want.netloc, want.query, want.fragment), u
        assert p.path == urlparse(u).path, u


@pytest.mark.parametrize("given, strict", [
    ("HTTPS://Shop.Example.com/Cart//?b=2#pay", "https://shop.example.com/Cart?b=2"), ("http://h.example.com", "http://h.example.com/"),
    ("//CDN.example.com/x/", "//cdn.example.com/x"), ("mailto:a@b.example", "mailto:a@b.example"), ("/only/path/", "/only/path"),
    ("https://h.example.com?q", "https://h.example.com/?q")])
def test_strict_form(spark, given, strict):
    assert spark.createDataFrame([(given,)], "u string").select(urls.strict_form("u")).first()[0] == strict


def test_without_query_keeps_fragment(table):
    for u, got in zip(URLS, _collect(table, urls.without_query("u"))):
        assert got == urlsplit(u)._replace(query="").geturl(), u


def test_param_names(table):
    for u, got in zip(URLS, _collect(table, urls.param_names_raw("u"))):
        if "%zz" not in u:
            assert got == list(parse_qs(urlparse(u).query)), u


def test_percent_encode(table):
    for u, got in zip(URLS, _collect(table, urls.percent_encode("u"))):
        assert got == quote(u, safe=":/?#[]@!$&'()*+,;="), u


@pytest.mark.parametrize("base", ["https://h.example.com/a/b", "https://h.example.com/a/b/", "https://h.example.com", "https://h.example.com/x?q=1#f"])
def test_resolve(spark, base):
    refs = ["/a", "b", "../b", "../../../b", "./b/.", "..", "/a//b/../c", "?q=2", "#f", "//cdn.example.com/x", "https://e.example.org/./a",
            "b/?x=1#y", "g;x=1/../y", "mailto:x@y.example", "a/b/../../c/"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string")
    got = [x[0] for x in df.orderBy("i").select(urls.resolve(F.lit(base), "r")).collect()]
    assert got == [urljoin(base, r) for r in refs]


def test_suffix_and_families(spark):
    df = spark.createDataFrame([("https://h/x/IMG.PNG?v=1",), ("https://h/.hidden",), ("https://h/a.b/",), ("https://h/",)], "u string")
    assert [r[0] for r in df.select(urls.path_suffix("u")).collect()] == [".png", "(none)", ".b", "(none)"]
    assert df.select(urls.has_suffix("u", (".png",))).first()[0]
    one = spark.createDataFrame([("https://h/?COLOR=red",)], "u string")
    assert one.select(urls.has_param("u", ("color",))).first()[0]
    assert not one.select(urls.has_param("u", ("size",))).first()[0]


def test_strict_form_at_a_look(spark):
    """URLs that are returned as they stand are those whose parts put together give the same."""
    rnd = random.Random(7)
    pieces = ["https:", "HTTP:", "//", "/", "h.example.com", "H.example", "a", "?", "#", ";", " ", "\t", "\n", "\x00", "ü", "%20", "?q=1", ":8080", "@", "&&"]
    rows = URLS + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    rows += ["https://h.example.com/" + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5))) for _ in range(3000)]
    df = spark.createDataFrame([(u,) for u in rows] + [(None,)], "u string")
    plain = F.regexp_replace(F.translate("u", "\t\r\n", ""), r"^[\x00-\x20]+", "")
    got = df.select("u", urls.strict_form("u").alias("a"), urls._strict_parts("u").alias("b"), urls._plain("u").alias("p"), plain.alias("q"),
                    F.col("u").rlike(urls._STRICT).alias("seen")).collect()
    assert [(r.u, r.a, r.b) for r in got if r.a != r.b] == [] and [(r.u, r.p, r.q) for r in got if r.p != r.q] == []
    assert sum(bool(r.seen) for r in got) > 200

"""The element tree and its selectors, against the standard library's parser and hand-made pages."""

import random
from html.parser import HTMLParser

import pytest

from siteloom.sources import html as X
from siteloom.sources.elements import VOID, Selector, tree, values

PAGE = """<!DOCTYPE html><html><head><title>T</title><meta charset=x></head><body><div id=a class="x y"><p>one<p class=y>two <b>bold</b> end</div>
<ul><li>1<li>2<ul><li>2a</ul><li>3</ul><div><span>s1</span><span data-k="v1" title="a, b">s2</span><em>e</em></div></p><br><a href="?a=1&amp;b=2">L</a>"""

CSS = {
    "div.y > p::text": ["one", "two ", " end"], "ul > li:nth-child(2)::text": ["2"], "li li::text": ["2a"], "span:not([data-k])::text": ["s1"],
    "span + em::text": ["e"], "span ~ em::text, #a b::text": ["bold", "e"], "body a::attr(href)": ["?a=1&b=2"], "p:not(.y)::text": ["one"],
    "li:last-child::text": ["2a", "3"], "div:first-of-type > p:last-of-type::text": ["two ", " end"], "[title='a, b']::text": ["s2"],
    "span[data-k$='1']::text": ["s2"], "span[data-k*=v]::text": ["s2"], "div > *:not(span)::text": ["one", "two ", " end", "e"], "em + span::text": [], "div.x.y::attr(ID)": ["a"],
    "span:not(:first-child)::text": ["s2"], "span[data-k^='']::text": []}
XPATH = {
    "count(//li)": 4, "//ul/li[2]/text()": ["2"], "//div[@id='a']//text()": ["one", "two ", "bold", " end"], "//span[not(@data-k)]/text()": ["s1"],
    "//span[contains(@data-k,'1')]/@data-k": ["v1"], "//ul/li[last()]/text()": ["2a", "3"], "count(/html/body/div)": 2, "count(/body)": 0, "//title/text()": ["T"], "//*[@charset]/@charset": ["x"]}


def test_selectors(spark):
    names = {f"c{i}": s for i, s in enumerate(CSS)}
    paths = {f"x{i}": s for i, s in enumerate(XPATH)}
    page = spark.createDataFrame([(PAGE,)], "html string").withColumn("t", tree(X.markup("html"), X.attributes))
    got = page.select(*(values(Selector.css(s), X.F.col("t")).alias(n) for n, s in names.items()), *(values(Selector.xpath(s), X.F.col("t")).alias(n) for n, s in paths.items())).first()
    assert {s: got[n] for n, s in names.items()} == CSS
    assert {s: got[n] for n, s in paths.items()} == XPATH


@pytest.mark.parametrize("text", ["p", "p::first-line", "p:hover::text", "> p::text", "p >::text", "p > > b::text", "p:not(.a.b)::text", "p:nth-child(2n+1)::text", "a::text, b::attr(x)", "::text", "p[::text"])
def test_css_that_is_not_supported(text):
    with pytest.raises(ValueError):
        Selector.css(text)


@pytest.mark.parametrize("text", ["//p", "p/text()", "//p[text()='a']/text()", "count(//p/@a)", "//p[@a][2]/text()", "//p//@a", "//p/ancestor::div/text()", "", "count(//p"])
def test_xpath_that_is_not_supported(text):
    with pytest.raises(ValueError):
        Selector.xpath(text)


class Scan(HTMLParser):
    """Elements of well-formed markup as (pre, post, parent, name)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        self.out.append([len(self.out), len(self.out), self.stack[-1] if self.stack else -1, tag])
        if tag not in VOID:
            self.stack.append(len(self.out) - 1)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.out[self.stack.pop()][1] = len(self.out) - 1


def test_intervals_of_random_trees(spark):
    rnd = random.Random(8)

    def grow(depth):
        tag = rnd.choice(["div", "span", "b", "i", "section", "img", "br"] if depth < 6 else ["img", "b"])
        if tag in VOID:
            return f"<{tag} a='>'>"
        return f"<{tag} k=\"<x>\">" + "".join(rnd.choice([grow(depth + 1), "t<1 "]) for _ in range(rnd.randint(0, 3))) + f"</{tag}>"

    pages = [(i, "".join(grow(0) for _ in range(4))) for i in range(40)]
    got = spark.createDataFrame(pages, "i int, html string").select("i", tree("html", X.attributes).alias("t")).collect()
    for r in got:
        scan = Scan()
        scan.feed(pages[r.i][1])
        assert [[e.pre, e.post, e.parent, e.name] for e in r.t.elements] == scan.out


def test_awkward_pages(spark):
    pages = [None, "", "no tags", "</p><b>x", "<p>a</b></p>", "<div><p>a<div>b</div>", "<", "<b" + "<i>" * 300]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: (len(r.t.elements), [t.text for t in r.t.texts]) for r in df.select("i", tree("html", X.attributes).alias("t")).collect()}
    assert got[0] == got[1] == (0, []) and got[2] == (0, ["no tags"]) and got[3] == (1, ["x"]) and got[4] == (1, ["a"]) and got[5] == (3, ["a", "b"])
    assert got[6] == (0, ["<"]) and got[7][0] >= 299


def test_extract_mixes_forms(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    r = X.extract(df, {"title": "title::text", "deep": "div.x p b::text"}, xpaths={"n": "count(//p)"}).first()
    assert (r.title, r.deep, r.n) == (["T"], ["bold"], 2)
    with pytest.raises(ValueError):
        X.extract(df, {"bad": "p:hover::text"})

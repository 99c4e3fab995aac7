"""Page HTML to crawl columns, with built-in string expressions only.

Comments and the bodies of scripts and styles are removed first. Opening tags
are then listed once per page, each with its name and its attributes, which are read from
the left, so that nothing inside a quoted value counts as an attribute. All columns look up that list.
Character references are decoded in attribute values and texts, after tags are told from text. Addresses are made absolute against
the page's base element, if it has one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.functions import urls
from siteloom.functions.constants import EXTRACTION_SELECTORS, LIST_DELIMITER
from siteloom.functions.references import decoded
from siteloom.sources.elements import Selector, tree, values
from siteloom.sources.markup import jsonld, open_graph

# A tag may hold '>' inside quotes; a tag with an open quote ends at its first '>'.
_TAG_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ANY_TAG = rf"<[/!?a-zA-Z](?:{_TAG_REST}|[^>]*>)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def markup(html) -> Column:
    """HTML without comments and without script and style bodies."""
    plain = F.regexp_replace(_col(html), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(
        plain, r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1</$2>")


def head_of(source) -> Column:
    """Content of all head elements; one without an end tag ends where the body begins."""
    found = F.regexp_extract_all(_col(source), F.lit(r"(?is)<head\b[^>]*>(.*?)(?=</head\s*>|<body\b|<head\b|$)"), F.lit(1))
    return F.array_join(found, "\n")


def opening_tags(source, *names: str) -> Column:
    return F.regexp_extract_all(_col(source), F.lit(rf"(?i)<(?:{'|'.join(names)})\b{_TAG_REST}"), F.lit(0))


# One attribute: its name, and its value in double, single or no quotes.
_ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""


def attributes(tag) -> Column:
    """All attributes of an opening tag as array<struct<name, value>>, read from the left."""
    body = F.regexp_replace(_col(tag), r"^<[a-zA-Z][^\s/>]*", "")
    found = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0))
    blanks = F.lit(" \t\n\r\f")

    def entry(a: Column) -> Column:
        name = F.substring_index(a, "=", 1)
        value = F.btrim(F.substr(a, F.length(name) + 2), blanks)
        quoted = value.startswith('"') | value.startswith("'")
        inner = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(F.btrim(name, blanks)).alias("name"), decoded(inner, in_attribute=True).alias("value"))

    return F.transform(found, entry)


def value_of(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name, null when absent."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name.lower()), F.lit(0))["value"]


def attribute(tag, name: str) -> Column:
    """Attribute value of an opening tag, null when absent."""
    return value_of(attributes(tag), name)


def parsed_tags(tags: Column) -> Column:
    """Opening tags as array<struct<name, attrs>>."""
    return F.transform(tags, lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"^<([a-zA-Z][^\s/>]*)", 1)).alias("name"), attributes(t).alias("attrs")))


def element_texts(source, name: str) -> Column:
    """Text of every element of a kind that has no children of the same kind."""
    found = F.regexp_extract_all(_col(source), F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))
    return F.transform(found, lambda e: decoded(without_tags(e)))


def without_tags(fragment) -> Column:
    return F.regexp_replace(_col(fragment), _ANY_TAG, "")


def _matcher(name: str, value: str | None):
    """Test of one attribute: present, equal, or for rel one of its words."""
    def test(tag: Column) -> Column:
        found = value_of(tag["attrs"], name)
        if value is None:
            return found.isNotNull()
        text = F.lower(F.coalesce(found, F.lit("")))
        if name == "rel":
            return F.array_contains(F.split(text, r"\s+"), value.lower())
        return text == value.lower()

    return test


@dataclass(frozen=True)
class Pick:
    """What to extract: an element, the attributes it must have, and what to read from it."""

    tag: str
    where: tuple[tuple[str, str | None], ...] = ()
    attr: str | None = None
    in_head: bool = False

    @classmethod
    def of(cls, selector: str) -> "Pick":
        """From the selector forms ``[head ]tag[[attr[=value]]]::text`` and ``…::attr(name)``."""
        m = re.fullmatch(
            r"(head )?(\w+)((?:\[[\w:-]+(?:=\"?[^\]\"]+\"?)?\])*)::(?:text|attr\(([\w:-]+)\))", selector.strip())
        if not m:
            raise ValueError(f"unsupported selector: {selector!r}")
        where = re.findall(r"\[([\w:-]+)(?:=\"?([^\]\"]+)\"?)?\]", m[3])
        return cls(m[2], tuple((a, v or None) for a, v in where), m[4], bool(m[1]))

    def tags(self) -> Column:
        """Matching tags of a prepared page."""
        wanted = F.col("_head_tags" if self.in_head else "_tags")
        tests = [_matcher(name, value) for name, value in self.where]

        def matches(tag: Column) -> Column:
            found = tag["name"] == self.tag.lower()
            for test in tests:
                found = found & test(tag)
            return found

        return F.filter(wanted, matches)

    def values(self) -> Column:
        if self.attr is None:
            return element_texts(F.col("_head" if self.in_head else "_markup"), self.tag)
        return F.filter(F.transform(self.tags(), lambda t: value_of(t["attrs"], self.attr)), lambda v: v.isNotNull())


def prepared(pages: DataFrame, tags: set[str], html: str = "html") -> DataFrame:
    """Adds what all columns of a page share, each computed once.

    ``_markup`` and ``_head`` are the cleaned source; ``_tags`` and
    ``_head_tags`` list the opening tags named with their attributes, so that the columns
    read a short list instead of scanning the page again.
    """
    cleaned = pages.withColumn("_markup", markup(html)).withColumn("_head", head_of("_markup"))
    return cleaned.withColumns({
        "_tags": parsed_tags(opening_tags("_markup", *sorted(tags))),
        "_head_tags": parsed_tags(opening_tags("_head", *sorted(tags)))})


_SHARED = ("_markup", "_head", "_tags", "_head_tags")


def extract(pages: DataFrame, selectors: dict[str, str], html: str = "html", xpaths: dict[str, str] | None = None) -> DataFrame:
    """Adds one list column per selector (a number for a count). Only the columns named are computed.

    Selectors of one element are looked up in the list of tags; others, and XPath, are matched on the element tree.
    """
    picks, trees = {}, {n: Selector.xpath(s) for n, s in (xpaths or {}).items()}
    for name, text in selectors.items():
        try:
            picks[name] = Pick.of(text)
        except ValueError:
            trees[name] = Selector.css(text)
    page = prepared(pages, {p.tag for p in picks.values()} or {"html"}, html)
    if trees:
        page = page.withColumn("_tree", tree("_markup", attributes))
    columns = {n: p.values() for n, p in picks.items()} | {n: values(s, F.col("_tree")) for n, s in trees.items()}
    return page.withColumns(columns).drop(*_SHARED, "_tree")


def merged_selectors(own: dict[str, str] | None = None) -> dict[str, str]:
    """The default selectors, a caller's selector of the same name taking precedence."""
    return {**EXTRACTION_SELECTORS, **(own or {})}


COUNTED_TAGS = {"head", "title", "link", "meta"}


def structure_counts() -> dict[str, Column]:
    """How often head, title, canonical and description occur, and how often inside the head."""
    def count(tag: str, where=(), in_head: bool = False):
        return F.size(Pick(tag, where, None, in_head).tags()).cast("bigint")

    canonical, desc = (("rel", "canonical"),), (("name", "description"),)
    return {
        "head_count": count("head"),
        "title_count": count("title"),
        "title_in_head_count": count("title", (), True),
        "canonical_total_count": count("link", canonical),
        "canonical_in_head_count": count("link", canonical, True),
        "meta_desc_total_count": count("meta", desc),
        "meta_desc_in_head_count": count("meta", desc, True),
    }


def body_text(source) -> Column:
    """Visible text of the body, one blank between pieces."""
    body = F.regexp_extract(_col(source), rf"(?is)<body\b{_TAG_REST}(.*?)(?:</body\s*>|$)", 1)
    blank = F.regexp_replace(decoded(F.regexp_replace(body, _ANY_TAG, " ")), r"(?U)\s+", " ")
    return F.trim(blank)


def base_url(tags: Column, page_url) -> Column:
    """Address that relative ones refer to: the first base element's among parsed ``tags``, else the page's."""
    own = F.get(F.filter(F.transform(F.filter(tags, lambda t: t["name"] == "base"), lambda t: F.trim(value_of(t["attrs"], "href"))),
                         lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    return F.when(own.isNull(), _col(page_url)).otherwise(urls.resolve(page_url, own))


def links(source, page_url) -> Column:
    """Anchors with an address: absolute URL, text, nofollow. ``page_url`` is the address they are relative to."""
    anchors = F.regexp_extract_all(_col(source), F.lit(rf"(?is)<a\b{_TAG_REST}.*?</a\s*>"), F.lit(0))

    def item(a: Column) -> Column:
        tag = F.regexp_extract(a, rf"(?is)^<a\b{_TAG_REST}", 0)
        return F.struct(attributes(tag).alias("attrs"), F.trim(decoded(without_tags(a))).alias("text"))

    def read(x: Column) -> Column:
        # Looked up here once: the link names its address in each of its parts.
        return F.struct(F.trim(value_of(x["attrs"], "href")).alias("href"), x["text"].alias("text"), value_of(x["attrs"], "rel").alias("rel"))

    def link(x: Column) -> Column:
        rel = F.lower(F.coalesce(x["rel"], F.lit("")))
        return F.struct(
            urls.resolve(page_url, x["href"]).alias("url"), x["text"].alias("text"),
            F.array_contains(F.split(rel, r"\s+"), "nofollow").alias("nofollow"))

    named = F.filter(F.transform(F.transform(anchors, item), read), lambda x: x["href"].isNotNull())
    return F.transform(named, link)


def nav_links(source, page_url) -> Column:
    menus = F.array_join(F.regexp_extract_all(
        _col(source), F.lit(r"(?is)<nav\b[^>]*>(.*?)</nav\s*>"), F.lit(1)), " ")
    return F.transform(links(menus, page_url), lambda x: x["url"])


def images(page_url) -> Column:
    """Image sources and alt texts of a prepared page."""
    tags = F.filter("_tags", lambda t: (t["name"] == "img") & value_of(t["attrs"], "src").isNotNull())
    return F.transform(tags, lambda t: F.struct(
        urls.resolve(page_url, F.trim(value_of(t["attrs"], "src"))).alias("src"), value_of(t["attrs"], "alt").alias("alt")))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def crawl_columns(pages: DataFrame, own_selectors: dict[str, str] | None = None) -> DataFrame:
    """pages(…, url, html) with every extraction column of the crawl schema added."""
    picks = {n: Pick.of(s) for n, s in merged_selectors(own_selectors).items()}
    lists = {n: p.values() for n, p in picks.items() if n not in ("hreflang_hreflang", "hreflang_href")}
    # Language and address come from one tag; tags without a language name no alternate.
    alternates = F.transform(Pick("link", (("rel", "alternate"),)).tags(), lambda t: F.struct(
        value_of(t["attrs"], "hreflang").alias("lang"), value_of(t["attrs"], "href").alias("href")))
    hreflang = F.filter(alternates, lambda a: a["lang"].isNotNull())
    joined = {
        n: F.nullif(F.array_join(lists.pop(n), LIST_DELIMITER), F.lit(""))
        for n in ("meta_robots", "html_lang", "meta_keywords", "meta_refresh", "rel_next", "rel_prev", "amphtml")
    }
    single = {
        "title": _first(element_texts("_markup", "title")),
        "meta_desc": _first(Pick.of("meta[name=description]::attr(content)").values()),
        "canonical": _first(Pick.of("link[rel=canonical]::attr(href)").values()),
        "viewport": _first(Pick.of("meta[name=viewport]::attr(content)").values()),
        "h1": element_texts("_markup", "h1"),
        "h2": element_texts("_markup", "h2"),
        "body_text": body_text("_markup"),
        "links": links("_markup", F.col("_base")),
        "nav_links_url": nav_links("_markup", F.col("_base")),
        "images": images(F.col("_base")),
        "jsonld": jsonld("html"),
        "og": open_graph(F.col("_tags"), value_of),
        "hreflang": hreflang,
        "size": F.octet_length("html").cast("bigint"),
    }
    columns = {**lists, **joined, **single, **structure_counts()}
    tags = COUNTED_TAGS | {"img", "base"} | {p.tag for p in picks.values()}
    page = prepared(pages, tags).withColumn("_base", base_url(F.col("_tags"), "url"))
    return page.withColumns(columns).drop(*_SHARED, "_base")

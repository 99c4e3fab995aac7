"""Selectors over the element tree of a stored page, with built-in expressions only.

A page is cut into tags and texts, and one stack scan gives every element its number in document order, the number of its last
descendant and its parent. A descendant test is then an interval test, a child test an equality. Matching goes
from left to right: each step keeps the elements that pass its own tests and stand in the asked relation to one of the elements before.

Elements that HTML leaves open are closed as the standard does it in the common cases: void elements hold nothing; a list item, a cell, a row,
an option, a term and a paragraph end where the next of their kind (for a paragraph: a block) begins; an end tag closes what is open
inside its element, and is passed over if no such element is open. Comments and the bodies of scripts and styles are no text.

CSS: ``tag``, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` (also ``^= $= *= ~=``), ``:first-child``, ``:last-child``,
``:nth-child(n)``, ``:first-of-type``, ``:last-of-type``, ``:nth-of-type(n)``, ``:not(...)`` of these, the combinators blank, ``>``, ``+``, ``~``, commas, and
at the end ``::text`` (the texts right below each element, piece by piece) or ``::attr(name)``. XPath: ``/`` and ``//`` steps of
``tag`` or ``*`` with predicates ``[@a]``, ``[@a='v']``, ``[contains(@a, 'v')]``, ``[not(...)]`` of these, ``[n]`` and ``[last()]``, ending in
``/text()``, ``//text()``, ``/@a`` or nothing under ``count(...)``. Everything else is a ``ValueError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from siteloom.functions.references import decoded

# ---- fixed values: HTML elements --------------------------------------------
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
#: What the begin of an element ends, as long as it is what stands open last.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
        "tbody": ("tr", "td", "th", "p", "thead", "tbody"), "option": ("option",), "body": ("head",), **{b: ("p",) for b in BLOCKS}}

_TOKEN = r"""(?s)</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*>|[^<]+|<"""
_STATE = ("struct<stack:array<struct<pre:int,name:string>>,seen:array<struct<pre:int,parent:int,name:string,raw:string>>,"
          "closed:array<struct<pre:int,post:int>>,texts:array<struct<parent:int,raw:string>>>")


def _tokens(source: Column) -> Column:
    ends = F.from_json(F.lit(_json(ENDS)), "map<string,array<string>>")

    def token(raw: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][^\s/>]*)", 1))
        kind = (F.when(raw.startswith("</") & (name != ""), "close").when(name == "", F.when(raw.rlike("^<[!?]"), "none").otherwise("text"))
                .when(name.isin(*VOID), "void").otherwise("open"))
        return F.struct(kind.alias("kind"), name.alias("name"), raw.alias("raw"))

    def full(t: Column) -> Column:
        over = F.when(t["kind"].isin("open", "void"), F.try_element_at(ends, t["name"]))
        return F.struct(t["kind"].alias("kind"), t["name"].alias("name"), t["raw"].alias("raw"), F.coalesce(over, F.array().cast("array<string>")).alias("ends"))

    return F.transform(F.transform(F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0)), token), full)


def _json(table: dict) -> str:
    return "{" + ",".join(f'"{k}":[' + ",".join(f'"{v}"' for v in vs) + "]" for k, vs in table.items()) + "}"


def _step(s: Column, t: Column) -> Column:
    """The scan after one more token."""
    n = F.size(s["seen"])
    open_names = F.reverse(F.transform(s["stack"], lambda e: e["name"]))
    other = F.array_position(F.transform(open_names, lambda name: F.array_contains(t["ends"], name)), F.lit(False))
    leave = (F.when(t["kind"] == "close", F.array_position(open_names, t["name"]))
             .when(F.size(t["ends"]) > 0, F.when(other == 0, F.size(s["stack"]).cast("long")).otherwise(other - 1)).otherwise(0)).cast("int")

    def after(k: Column) -> Column:
        stack = F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - k)
        parent = F.coalesce(F.try_element_at(stack, F.lit(-1))["pre"], F.lit(-1))
        here = F.array(F.struct(n.alias("pre"), parent.alias("parent"), t["name"].alias("name"), t["raw"].alias("raw")))
        gone = F.transform(F.slice(F.reverse(s["stack"]), F.lit(1), k), lambda e: F.struct(e["pre"].alias("pre"), (n - 1).alias("post")))
        starts = t["kind"].isin("open", "void")
        return F.struct(
            F.when(t["kind"] == "open", F.concat(stack, F.array(F.struct(n.alias("pre"), t["name"].alias("name"))))).otherwise(stack).alias("stack"),
            F.when(starts, F.concat(s["seen"], here)).otherwise(s["seen"]).alias("seen"),
            F.when(t["kind"] == "void", F.concat(s["closed"], gone, F.array(F.struct(n.alias("pre"), n.alias("post"))))).otherwise(F.concat(s["closed"], gone)).alias("closed"),
            F.when(t["kind"] == "text", F.concat(s["texts"], F.array(F.struct(parent.alias("parent"), t["raw"].alias("raw"))))).otherwise(s["texts"]).alias("texts"),
        ).cast(_STATE)

    return F.get(F.transform(F.array(leave), after), F.lit(0))


def tree(source, attributes: Callable[[Column], Column]) -> Column:
    """Elements (pre, post, parent, name, attrs) and texts (parent, text) of cleaned markup, each in document order."""
    source = F.col(source) if isinstance(source, str) else source
    empty = F.struct(*(F.array().alias(n) for n in ("stack", "seen", "closed", "texts"))).cast(_STATE)

    def finish(s: Column) -> Column:
        rest = F.transform(s["stack"], lambda e: F.struct(e["pre"].alias("pre"), (F.size(s["seen"]) - 1).alias("post")))
        return F.struct(s["seen"].alias("seen"), F.array_sort(F.concat(s["closed"], rest)).alias("closed"), s["texts"].alias("texts"))

    def dressed(s: Column) -> Column:
        elements = F.transform(s["seen"], lambda e: F.struct(
            e["pre"].alias("pre"), F.get(s["closed"], e["pre"])["post"].alias("post"), e["parent"].alias("parent"), e["name"].alias("name"), attributes(e["raw"]).alias("attrs")))
        texts = F.transform(s["texts"], lambda t: F.struct(t["parent"].alias("parent"), decoded(t["raw"]).alias("text")))
        return F.struct(elements.alias("elements"), texts.alias("texts"))

    scanned = F.aggregate(_tokens(F.coalesce(source, F.lit(""))), empty, _step, finish)
    return F.get(F.transform(F.array(scanned), dressed), F.lit(0))


# ---- selectors ----------------------------------------------------------------
@dataclass(frozen=True)
class Test:
    """One condition on an element: ``attr`` (name, operator, value), or ``nth`` (among all or its own kind, from which end, number); negated or not."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    negated: bool = False


@dataclass(frozen=True)
class Step:
    """Relation to the step before, element name or ``*``, and the tests."""

    relation: str
    tag: str
    tests: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Selector:
    """Alternatives of steps, and what is read: text, alltext, count, or an attribute."""

    paths: tuple[tuple[Step, ...], ...]
    read: str
    attr: str = ""

    @classmethod
    def css(cls, text: str) -> "Selector":
        # Every alternative says what it reads, and all the same.
        parts = [re.fullmatch(r"(.*?)::(?:(text)|attr\(([\w:-]+)\))", p.strip(), re.S) for p in re.split(r",(?![^\[(]*[\])])", text)]
        if not all(parts) or len({m.groups()[1:] for m in parts}) > 1:
            raise ValueError(f"unsupported selector: {text!r}")
        return cls(tuple(_css_path(m[1], text) for m in parts), "text" if parts[0][2] else "attr", parts[0][3] or "")

    @classmethod
    def xpath(cls, text: str) -> "Selector":
        body, counted = text.strip(), re.fullmatch(r"count\((.*)\)", text.strip(), re.S)
        body = counted[1] if counted else body
        m = re.fullmatch(r"(.*?)(?:(//|/)(text\(\)|@[\w:-]+))?", body, re.S)
        read = "count" if counted else {"text()": "text"}.get(m[3] or "", "attr")
        if (m[3] is None) != bool(counted) or (read == "attr" and m[2] == "//"):
            raise ValueError(f"unsupported selector: {text!r}")
        if read == "text" and m[2] == "//":
            read = "alltext"
        return cls((_xpath_path(m[1], text),), read, (m[3] or "").removeprefix("@") if read == "attr" else "")


_ATTR = r"""\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s"']+))\s*)?\]"""
_SIMPLE = rf"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|(?P<attr>{_ATTR})|:(?P<pos>first-child|last-child|first-of-type|last-of-type)|:(?P<nth>nth-child|nth-of-type)\(\s*(?P<n>\d+)\s*\)"""


def _css_tests(text: str, whole: str) -> tuple[Test, ...]:
    out, at = [], 0
    while at < len(text):
        m = re.compile(_SIMPLE).match(text, at)
        inner = re.compile(r":not\(\s*([^()]*(?:\([^()]*\))?[^()]*)\)").match(text, at)
        if inner:
            tag = re.match(r"[a-zA-Z][\w-]*|", inner[1])[0]
            tests = _css_tests(inner[1][len(tag):].strip(), whole) + ((Test("tag", value=tag.lower()),) if tag else ())
            if len(tests) != 1:
                raise ValueError(f"unsupported selector: {whole!r}")
            out.append(replace(tests[0], negated=True))
        elif not m:
            raise ValueError(f"unsupported selector: {whole!r}")
        elif m["cls"]:
            out.append(Test("attr", "class", "~=", m["cls"]))
        elif m["id"]:
            out.append(Test("attr", "id", "=", m["id"]))
        elif m["attr"]:
            name, op, *values = re.fullmatch(_ATTR, m["attr"]).groups()
            out.append(Test("attr", name.lower(), op or "", next((v for v in values if v is not None), "")))
        else:
            name = m["pos"] or m["nth"]
            out.append(Test("nth", "type" if name.endswith("type") else "all", "last" if name.startswith("last") else "first", m["n"] or "1"))
        at = (inner or m).end()
    return tuple(out)


def _css_path(text: str, whole: str) -> tuple[Step, ...]:
    # Blanks and signs inside brackets belong to a test.
    pieces = re.findall(r"\s*[>+~](?!=)\s*|\s+|(?:\[[^\]]*\]|\([^)]*\)+|[^\s>+~\[(])+", text.strip())
    if not pieces or "".join(pieces) != text.strip():
        raise ValueError(f"unsupported selector: {whole!r}")
    steps, relation = [], ""
    for piece in pieces:
        sign = piece.strip()
        if sign in ("", ">", "+", "~"):
            if not steps or relation:
                raise ValueError(f"unsupported selector: {whole!r}")
            relation = sign or " "
            continue
        tag = re.match(r"\*|[a-zA-Z][\w-]*|", sign)[0]
        steps.append(Step(relation, tag.lower() or "*", _css_tests(sign[len(tag):], whole)))
        relation = ""
    if relation:
        raise ValueError(f"unsupported selector: {whole!r}")
    return tuple(steps)


_PREDICATE = r"""\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|(?P<not>not\(\s*)?(?:contains\(\s*@(?P<part>[\w:-]+)\s*,\s*(?P<pv>"[^"]*"|'[^']*')\s*\)|@(?P<name>[\w:-]+)\s*(?:=\s*(?P<v>"[^"]*"|'[^']*'))?)\s*(?(not)\)))\s*\]"""


def _xpath_path(text: str, whole: str) -> tuple[Step, ...]:
    step = re.compile(rf"(//|/)([a-zA-Z][\w-]*|\*)((?:{re.sub(r'[(][?]P<[a-z]+>', '(?:', _PREDICATE).replace('(?(not)' + chr(92) + '))', '[)]?')})*)")
    steps, at = [], 0
    while at < len(text):
        m = step.match(text, at)
        if not m:
            raise ValueError(f"unsupported selector: {whole!r}")
        tests = []
        for p in re.finditer(_PREDICATE, m[3]):
            if p["n"] or p["last"]:
                tests.append(Test("nth", "all" if m[2] == "*" else "type", "last" if p["last"] else "first", p["n"] or "1"))
            else:
                value = p["pv"] or p["v"]
                tests.append(Test("attr", (p["part"] or p["name"]).lower(), "*=" if p["part"] else "=" if value else "", value[1:-1] if value else "", bool(p["not"])))
        # Positions count among all of a kind; after another test that would not be so.
        if any(t.kind == "nth" for t in tests[1:]):
            raise ValueError(f"unsupported selector: {whole!r}")
        steps.append(Step((" " if m[1] == "//" else ">") if steps else ("" if m[1] == "//" else "root"), m[2].lower(), tuple(tests)))
        at = m.end()
    if not steps:
        raise ValueError(f"unsupported selector: {whole!r}")
    return tuple(steps)


# ---- matching -----------------------------------------------------------------
def _value(e: Column, name: str) -> Column:
    return F.get(F.filter(e["attrs"], lambda a: a["name"] == name), F.lit(0))["value"]


def _passes(e: Column, test: Test, elements: Column) -> Column:
    if test.kind == "tag":
        found = e["name"] == test.value
    elif test.kind == "nth":
        def beside(x: Column) -> Column:
            near = (x["parent"] == e["parent"]) & ((x["pre"] > e["pre"]) if test.op == "last" else (x["pre"] < e["pre"]))
            return near & (x["name"] == e["name"]) if test.name == "type" else near

        found = F.size(F.filter(elements, beside)) == int(test.value) - 1
    else:
        value = _value(e, test.name)
        if test.op == "":
            found = value.isNotNull()
        else:
            text = F.coalesce(value, F.lit(""))
            wanted = test.value
            some = F.lit(wanted != "")  # an empty part matches nothing
            found = {"=": value.isNotNull() & (text == wanted), "^=": some & text.startswith(wanted), "$=": some & text.endswith(wanted),
                     "*=": some & text.contains(wanted), "~=": F.array_contains(F.split(text, r"\s+"), wanted) & some}[test.op]
    return ~found if test.negated else found


def _related(e: Column, before: Column, relation: str, elements: Column) -> Column:
    if relation == " ":
        return F.exists(before, lambda a: (a["pre"] < e["pre"]) & (e["pre"] <= a["post"]))
    if relation == ">":
        return F.exists(before, lambda a: a["pre"] == e["parent"])
    if relation == "~":
        return F.exists(before, lambda a: (a["parent"] == e["parent"]) & (a["pre"] < e["pre"]))
    # The element before ends right before this one begins.
    return F.exists(before, lambda a: (a["parent"] == e["parent"]) & (a["post"] == e["pre"] - 1))


def _keeper(step: Step, before: Column | None, elements: Column) -> Callable[[Column], Column]:
    def keep(e: Column) -> Column:
        test = F.lit(True) if step.tag == "*" else e["name"] == step.tag
        for t in step.tests:
            test = test & _passes(e, t, elements)
        if step.relation == "root":
            test = test & (e["parent"] == -1)
        return test if before is None else test & _related(e, before, step.relation, elements)

    return keep


def _matched(path: tuple[Step, ...], elements: Column) -> Column:
    found = F.filter(elements, _keeper(path[0], None, elements))
    for step in path[1:]:
        found = _bound(found, _next(step, elements))
    return found


def _next(step: Step, elements: Column) -> Callable[[Column], Column]:
    return lambda before: F.filter(elements, _keeper(step, before, elements))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def values(selector: Selector, page: Column) -> Column:
    """What the selector reads from a page of :func:`tree`: a list, or a number for a count."""
    elements = page["elements"]
    found = _matched(selector.paths[0], elements)
    for path in selector.paths[1:]:
        found = F.array_sort(F.array_union(found, _matched(path, elements)))
    if selector.read == "count":
        return F.size(found).cast("bigint")
    if selector.read == "attr":
        return F.filter(F.transform(found, lambda e: _value(e, selector.attr.lower())), lambda v: v.isNotNull())

    def read(found: Column) -> Column:
        def inside(t: Column) -> Column:
            if selector.read == "text":
                return F.exists(found, lambda e: e["pre"] == t["parent"])
            return F.exists(found, lambda e: (e["pre"] <= t["parent"]) & (t["parent"] <= e["post"]))

        return F.transform(F.filter(page["texts"], inside), lambda t: t["text"])

    return _bound(found, read)

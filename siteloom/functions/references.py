"""HTML character references, with built-in expressions only.

The names are the published table of the HTML standard, as the Python library carries it. It enters a plan as one
string that is read into a map when the plan is optimised, two levels deep by first letter, so a look-up
passes few entries. Text without ``&`` is returned as it is. The decoder is one SQL lambda that is parsed once per
session: built call by call for every column, it took longer than the reading of the pages.
"""

from __future__ import annotations

import html
import html.entities
import json
from functools import cache

from pyspark.sql import Column, SparkSession, functions as F

#: What the standard reads numeric references 128 to 159 as (the others stand for themselves).
_WINDOWS_1252 = {c: html.unescape(f"&#{c};") for c in range(128, 160)}
_CLOSED = {n[:-1]: c for n, c in html.entities.html5.items() if n.endswith(";")}
#: Names that count without a semicolon, longest first.
_OPEN = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_letter() -> str:
    table: dict[str, dict[str, str]] = {}
    for name, text in _CLOSED.items():
        table.setdefault(name[0], {})[name] = text
    return json.dumps(table)


_TABLE, _C1 = _by_letter(), json.dumps({str(c): t for c, t in _WINDOWS_1252.items()})
_OPEN_TABLE, _OPEN_NAME = json.dumps({n: html.entities.html5[n] for n in _OPEN}), "^(?:" + "|".join(_OPEN) + ")"


#: Names that make up nearly all references; they are compared before the table is looked up.
COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "ndash", "mdash", "hellip", "rsquo")

_DECIMAL, _HEXADECIMAL, _NAME = _q(r"^#([0-9]+);?"), _q(r"^#[xX]([0-9a-fA-F]+);?"), _q(r"^([A-Za-z][A-Za-z0-9]*);")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once, however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _named(name: str) -> str:
    common = " ".join(f"WHEN {_q(w)} THEN {_q(_CLOSED[w])}" for w in COMMON)
    table = f"from_json({_q(_TABLE)}, 'map<string,map<string,string>>')"
    return f"CASE {name} {common} ELSE try_element_at(try_element_at({table}, left({name}, 1)), {name}) END"


def _numbered(digits: str, base: int) -> str:
    """The character of a code point; U+FFFD where there is none."""
    code = f"CASE WHEN length(short) <= 7 THEN CAST(conv(if(short = '', '0', short), {base}, 10) AS BIGINT) END"
    character = f"""CASE
        WHEN code IS NULL OR code = 0 OR code BETWEEN {0xD800} AND {0xDFFF} OR code > {0x10FFFF} THEN '\ufffd'
        WHEN code BETWEEN 128 AND 159 THEN try_element_at(from_json({_q(_C1)}, 'map<string,string>'), CAST(code AS STRING))
        ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END"""
    return _let("short", f"regexp_replace({digits}, '^0+', '')", _let("code", code, character))


def _number(p: str) -> str:
    cases = " ".join(
        f"WHEN {p} RLIKE {form} THEN concat({_numbered(f'regexp_extract({p}, {form}, 1)', base)}, regexp_replace({p}, {form}, ''))"
        for form, base in ((_DECIMAL, 10), (_HEXADECIMAL, 16)))
    return f"CASE {cases} END"


def _word(p: str, in_attribute: bool) -> str:
    """A closed name of the table, else the longest name that may stand open; null if neither."""
    found = f"concat(try_element_at(from_json({_q(_OPEN_TABLE)}, 'map<string,string>'), opened), rest)"
    # Inside an attribute "&copy=2" is a parameter, no sign.
    if in_attribute:
        found = f"CASE WHEN NOT rest RLIKE '^[=A-Za-z0-9]' THEN {found} END"
    opened = _let("opened", f"regexp_extract({p}, {_q(_OPEN_NAME)}, 0)", _let("rest", f"substr({p}, length(opened) + 1)", found))
    closed = f"CASE WHEN name <> '' THEN concat({_named('name')}, substr({p}, length(name) + 2)) END"
    return _let("name", f"regexp_extract({p}, {_NAME}, 1)", f"coalesce({closed}, {opened})")


@cache
def _decoder(session: str, in_attribute: bool) -> Column:
    piece = f"coalesce(CASE WHEN startswith(p, '#') THEN {_number('p')} ELSE {_word('p', in_attribute)} END, concat('&', p))"
    joined = f"concat(pieces[0], array_join(transform(slice(pieces, 2, size(pieces) - 1), p -> {piece}), ''))"
    return F.expr(f"t -> CASE WHEN NOT contains(t, '&') THEN t ELSE {_let('pieces', 'split(t, %s, -1)' % _q('&'), joined)} END")


def decoded_all(texts: Column, in_attribute: bool = False) -> Column:
    """An array of texts with the character references of each replaced; a null among them stays null."""
    session = SparkSession.active().sparkContext.applicationId
    return F.call_function("transform", texts, _decoder(session, in_attribute))


def decoded(text, in_attribute: bool = False) -> Column:
    """``text`` with its character references replaced; null stays null."""
    return F.get(decoded_all(F.array(F.col(text) if isinstance(text, str) else text), in_attribute), F.lit(0))

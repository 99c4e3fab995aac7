"""Structured data of stored pages: JSON-LD blocks and Open Graph fields, per row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siteloom.functions.constants import LIST_DELIMITER

#: A comment is passed over; a script is taken whole, so a comment sign inside it is none.
_SCRIPTS = r"""(?is)<!--.*?-->|<script\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?</script\s*>"""
_JSONLD = r"""(?is)^<script\b[^>]*?\stype\s*=\s*["']?\s*application/ld\+json\b"""
_BODY = r"""(?is)^<script\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>(.*)</script\s*>$"""


def jsonld_blocks(html) -> Column:
    """Bodies of all JSON-LD scripts outside comments, in order."""
    html = F.col(html) if isinstance(html, str) else html
    scripts = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_SCRIPTS), F.lit(0)), lambda s: s.rlike(_JSONLD))
    return F.transform(scripts, lambda s: F.regexp_extract(s, _BODY, 1))


def nesting(text: Column) -> Column:
    """How deep objects and lists of a JSON text are nested; strings do not count."""
    brackets = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"[\[{\]}]"), F.lit(0))
    opened = brackets.isNotNull()  # keeps the lambda below over a plain list
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, b: Column) -> Column:
        now = at["now"] + F.when(b.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.when(opened, F.aggregate(brackets, start, step, lambda at: at["most"]))


_ENTRY = "array<struct<path:string,value:variant>>"


def _opened(item: Column) -> Column:
    """One level: an object gives its members, a list its items under the same path, a value itself."""
    value = item["value"]
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    items = F.try_variant_get(value, "$", "array<variant>")
    kind = F.schema_of_variant(value)

    def named(m: Column) -> Column:
        return F.struct(F.when(item["path"] == "", m["key"]).otherwise(F.concat(item["path"], F.lit("."), m["key"])).alias("path"), m["value"].alias("value"))

    return (F.when(kind.startswith("OBJECT"), F.transform(members, named))
            .when(kind.startswith("ARRAY"), F.transform(items, lambda v: F.struct(item["path"].alias("path"), v.alias("value"))))
            .otherwise(F.array(F.struct(item["path"].alias("path"), value.alias("value")))).cast(_ENTRY))


def flattened(text: Column) -> Column:
    """A JSON text as array<struct<path, value>> of its plain values, at whatever depth; null if it is not JSON.

    Members of nested objects are joined by dots; items of a list share the path of the list.
    """
    def leaves_of(parsed: Column) -> Column:
        first = F.array(F.struct(F.lit("").alias("path"), parsed.alias("value"))).cast(_ENTRY)
        leaves = F.aggregate(F.sequence(F.lit(0), nesting(text)), first, lambda acc, _: F.flatten(F.transform(acc, _opened)).cast(_ENTRY))
        plain = F.transform(leaves, lambda e: F.struct(e["path"].alias("path"), F.try_variant_get(e["value"], "$", "string").alias("value")))
        return F.when(parsed.isNotNull(), F.filter(plain, lambda e: e["value"].isNotNull() & (e["path"] != "")))

    return _let(F.try_parse_json(text), leaves_of)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by_path(entries: Column) -> Column:
    """Entries as a map; values of one path are joined in order. Entries are computed once, not once per path."""
    def mapped(found: Column) -> Column:
        def joined(p: Column) -> Column:
            return F.array_join(F.transform(F.filter(found, lambda e: e["path"] == p), lambda e: e["value"]), LIST_DELIMITER)

        return _let(F.array_distinct(F.transform(found, lambda e: e["path"])), lambda paths: F.map_from_arrays(paths, F.transform(paths, joined)))

    return _let(entries, mapped)


def jsonld(html) -> Column:
    """All JSON-LD of a page as a map of key paths.

    The first block's paths stand as they are, those of block n (from 1) after ``n_``. A block that
    is no JSON gives ``errors``, so that it counts as markup without type.
    """
    def block(text: Column, i: Column) -> Column:
        prefix = F.when(i == 0, "").otherwise(F.concat(i.cast("string"), F.lit("_")))
        broken = F.array(F.struct(F.concat(prefix, F.lit("errors")).alias("path"), F.lit("not JSON").alias("value")))
        entries = F.transform(flattened(text), lambda e: F.struct(F.concat(prefix, e["path"]).alias("path"), e["value"].alias("value")))
        return F.coalesce(entries, broken)

    return _by_path(F.flatten(F.transform(jsonld_blocks(html), block)))


def open_graph(tags: Column, value_of) -> Column:
    """``og:`` and ``twitter:`` fields of the meta tags of a page; repeated ones are joined."""
    name = lambda t: F.lower(F.trim(F.coalesce(value_of(t["attrs"], "property"), value_of(t["attrs"], "name"), F.lit(""))))
    fields = F.transform(F.filter(tags, lambda t: t["name"] == "meta"), lambda t: F.struct(
        name(t).alias("path"), F.coalesce(value_of(t["attrs"], "content"), F.lit("")).alias("value")))
    return _by_path(F.filter(fields, lambda f: f["path"].rlike("^(og|twitter):")))

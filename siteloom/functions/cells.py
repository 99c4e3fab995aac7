"""Expressions on single cells: lists, numbers, headers, text."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column, functions as F

from siteloom.functions.constants import LIST_DELIMITER

# Whitespace as str.split() sees it: Unicode white space plus the four separators.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c) -> Column:
    """Null for null and for the text 'nan'."""
    return F.when(F.lower(_col(c)) != "nan", _col(c))


def clean(c) -> Column:
    return F.coalesce(known(c), F.lit(""))


def split_list(c) -> Column:
    """Items of a delimited cell: none for an empty cell, inner empties kept."""
    cell = clean(c)
    return F.when(cell == "", F.array().cast("array<string>")).otherwise(F.split(cell, LIST_DELIMITER, -1))


def to_double(c) -> Column:
    return F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))


def to_int(c) -> Column:
    """Truncated through double, null when not a number."""
    return to_double(c).try_cast("bigint")


def to_float(c) -> Column:
    return F.round(to_double(c), 4)


def comma_number(c) -> Column:
    return to_double(F.trim(F.replace(_col(c), F.lit(","), F.lit(""))))


def status_phrase(code) -> Column:
    pairs = [F.lit(v) for s in HTTPStatus for v in (int(s), s.phrase)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(code).cast("int")), F.lit(""))


def word_count(text) -> Column:
    words = F.filter(F.split(_col(text), _SPACE), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def header(headers, name: str) -> Column:
    """Header value by case-insensitive name; map keys are lower case."""
    return F.try_element_at(_col(headers), F.lit(name.lower()))


def first_non_blank(*cols) -> Column:
    """First trimmed non-blank value, '' when all are blank."""
    trimmed = [F.nullif(F.trim(_col(c)), F.lit("")) for c in cols]
    return F.coalesce(*trimmed, F.lit(""))


def count_non_blank(*cols) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.when(F.trim(_col(c)) != "", 1).otherwise(0)
    return total


def is_html(headers) -> Column:
    return F.coalesce(F.lower(header(headers, "content-type")).contains("html"), F.lit(False))


def at(items, i: int) -> Column:
    return F.coalesce(F.get(_col(items), F.lit(i)), F.lit(""))

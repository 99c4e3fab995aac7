"""Column slices of a crawl: projection, typed filters, paging."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


class Comparison(Enum):
    """What a filter asks of a column, by the sign users write."""

    EQUAL = "=="
    UNEQUAL = "!="
    LESS = "<"
    AT_MOST = "<="
    MORE = ">"
    AT_LEAST = ">="
    AMONG = "in"
    NOT_AMONG = "not_in"
    HOLDS = "contains"
    ABSENT = "is_null"
    GIVEN = "not_null"

    @property
    def needs(self) -> str:
        """Kind of value: none, list or one."""
        if self in (Comparison.ABSENT, Comparison.GIVEN):
            return "none"
        return "list" if self in (Comparison.AMONG, Comparison.NOT_AMONG) else "one"


@dataclass(frozen=True)
class Filter:
    """One test of one column, checked against the schema before anything is read."""

    column: str
    comparison: Comparison = Comparison.EQUAL
    value: Any = None

    @classmethod
    def parse(cls, raw: "Filter | dict[str, Any]") -> "Filter":
        if isinstance(raw, Filter):
            return raw
        sign = raw.get("op", Comparison.EQUAL.value)
        signs = [c.value for c in Comparison]
        if sign not in signs:
            raise ValueError(f"{sign!r} is none of {signs}")
        return cls(raw["column"], Comparison(sign), raw.get("value"))

    def over(self, schema: T.StructType) -> Column:
        """The test as an expression on a table of that schema."""
        if self.column not in schema.names:
            raise ValueError(f"the table has no column {self.column!r}")
        kind, needs = schema[self.column].dataType, self.comparison.needs
        if needs == "list" and not isinstance(self.value, (list, tuple, set)):
            raise ValueError(f"{self.comparison.value} on {self.column!r} takes a list")
        if needs == "one" and (self.value is None or isinstance(self.value, (list, tuple, set, dict))):
            raise ValueError(f"{self.comparison.value} on {self.column!r} takes one value")
        c = F.col(f"`{self.column}`")
        if self.comparison is Comparison.ABSENT:
            return c.isNull()
        if self.comparison is Comparison.GIVEN:
            return c.isNotNull()
        if self.comparison is Comparison.HOLDS:
            return F.contains(c.cast("string"), F.lit(str(self.value)))
        if needs == "list":
            found = F.coalesce(c.isin([v for v in self.value if v is not None]), F.lit(False))
            return found if self.comparison is Comparison.AMONG else ~found
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"{self.column!r} holds nested values, which do not compare")
        v = F.lit(self.value)
        match self.comparison:
            case Comparison.EQUAL:
                return c == v
            case Comparison.UNEQUAL:
                return c != v
            case Comparison.LESS | Comparison.AT_LEAST:
                below = c < v
                return below if self.comparison is Comparison.LESS else ~below
            case _:
                above = c > v
                return above if self.comparison is Comparison.MORE else ~above


def condition(df: DataFrame, filters: list[Filter | dict[str, Any]]) -> Column:
    """All filters at once; without any, every row passes."""
    tests = [Filter.parse(f).over(df.schema) for f in filters]
    return _all(tests) if tests else F.lit(True)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def select_rows(df: DataFrame, columns: list[str] | None = None,
                filters: list[Filter | dict[str, Any]] | None = None) -> DataFrame:
    """Filtered and projected rows; both reach the scan."""
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    kept = df.where(condition(df, filters)) if filters else df
    return kept.select(*[F.col(f"`{c}`") for c in columns]) if columns else kept


def page(df: DataFrame, columns: list[str], filters: list[Filter | dict[str, Any]] | None = None,
         limit: int = 100, after: dict[str, Any] | None = None, order: tuple[str, ...] = ("crawl_id", "seq")) -> DataFrame:
    """The ``limit`` rows that follow the row ``after`` (its values of ``order``), with ``has_more``.

    Pages are found by key: whatever the page, limit + 1 rows leave the scan tasks, and the
    key test reaches the scan.
    """
    keep = list(dict.fromkeys([*columns, *order]))
    rows = select_rows(df, keep, filters)
    if after is not None:
        later, tied = F.lit(False), F.lit(True)
        for c in order:
            value = F.lit(after[c])
            later = later | (tied & (F.col(f"`{c}`") > value))
            tied = tied & (F.col(f"`{c}`") == value)
        rows = rows.where(later)
    found = rows.orderBy(*order).limit(limit + 1)
    # At most limit + 1 rows are left to number.
    numbered = found.withColumn("_i", F.row_number().over(Window.orderBy(*order)))
    more = F.count("*").over(Window.partitionBy(F.lit(0))) > limit
    return numbered.withColumn("has_more", more).where(F.col("_i") <= limit).select(*columns, "has_more")


def by_prefix(df: DataFrame, exact: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Only the named columns that exist, plus those starting with a prefix."""
    wanted = [c for c in df.columns if c in exact or c.startswith(tuple(prefixes) or ("\0",))]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def newest(df: DataFrame, by: list[str], limit: int = 50) -> DataFrame:
    """Newest-first list with a limit."""
    return df.orderBy(*[F.desc(c) for c in by]).limit(limit)

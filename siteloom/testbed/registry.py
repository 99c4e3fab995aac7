"""Query registry: a Spark callable and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.session import tune
from siteloom.testbed import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the derived tables it names, and those they name."""
    known = {**derived.ctes(), **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in ordered and sql is not text and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(sql)
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    parts = [f"{n} AS ({known[n]})" for n in ordered]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, extra)
        return run

    return register

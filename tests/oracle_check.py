"""Compare a registered query with its SQL twin in DuckDB, value by value."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() else round(v, 9))
    if hasattr(v, "as_integer_ratio"):
        return _value(float(v)) if not isinstance(v, int) else v
    return v


def difference(spark, con, fn, sql: str, sf_dir: str):
    """None when equal, else a short account of what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = Counter(tuple(_value(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = Counter(tuple(_value(r[i]) for i in at) for r in cur.fetchall())
    if left == right:
        return None
    return (f"{sum(left.values())} vs {sum(right.values())} rows; columns {cols}; "
            f"only Spark {list((left - right).items())[:3]}; only SQL {list((right - left).items())[:3]}")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                diff = difference(spark, con, fn, oracle[name], sf)
            else:
                diff = f"rows only: {fn(spark, sf).count()}"
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(diff) and not diff.startswith("rows only")
        print(f"{name}: {diff or 'equal'} ({time.time() - start:.1f}s)", flush=True)
    print("bad:", bad)

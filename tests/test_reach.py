"""The walk over links: depths, seeds, what a level moves."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import reach as R


def walk(edges, seeds, depth):
    seen, level = {s: 0 for s in seeds}, set(seeds)
    for d in range(1, depth + 1):
        level = {t for c, u, t in edges if u is not None and t is not None and c is not None and (c, u) in level for t in [(c, t)]} - set(seen)
        seen.update({p: d for p in level})
    return seen


def tables(spark, edges, seeds):
    return spark.createDataFrame(edges, "crawl_id string, url string, link string"), spark.createDataFrame(seeds, "crawl_id string, url string")


def got(df):
    rows = [((r.crawl_id, r.url), r.depth) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("depth", [0, 2, 20])
def test_depths_against_a_plain_walk(spark, depth):
    edges = [("a", f"u{i}", f"u{(i * 7 + k) % 60}") for i in range(60) for k in (1, 2)]
    edges += [("b", "u1", "u2"), ("b", "u2", "u1"), ("a", "u5", None), ("a", None, "u9"), (None, "u0", "u3"), ("a", "u0", "u1")]
    seeds = [("a", "u0"), ("a", "u0"), ("b", "u1"), ("a", None)]
    assert got(R.reach(*tables(spark, edges, seeds), depth)) == walk(edges, set(seeds), depth)


def test_long_chain_merges_visited_tables(spark, monkeypatch):
    monkeypatch.setattr(R, "FAN", 2)
    edges = [("a", f"u{i}", f"u{i + 1}") for i in range(12)] + [("a", f"u{i}", "u0") for i in range(0, 12, 3)]
    assert got(R.reach(*tables(spark, edges, [("a", "u0")]), 9)) == {("a", f"u{i}"): i for i in range(10)}


def test_empty_tables_and_names(spark):
    assert got(R.reach(*tables(spark, [], [("a", "x")]), 2)) == {("a", "x"): 0}
    assert got(R.reach(*tables(spark, [("a", "x", "y")], []), 2)) == {}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siteloom_")]


def test_a_level_moves_its_targets_only(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    buckets = R.Buckets(spark)
    try:
        edges, _, n = buckets.write(buckets.deal(spark.range(200).selectExpr("'a' crawl_id", "concat('u', id) url", "concat('u', id * 2) target")), "edges")
        assert n == 200
        visited = R.Visited(buckets)
        for k in range(3):
            level, _, _ = buckets.write(buckets.deal(spark.range(k, k + 1).selectExpr("'a' crawl_id", "concat('u', id) url")), "level")
            visited.add(level)
        plan = R.next_level(edges, level, visited)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and text.count("Bucketed: true") == 5
        assert plan.select(F.col("url")).collect() == [("u4",)]
    finally:
        buckets.forget()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)

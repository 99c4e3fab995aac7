"""Group operators against plain windows, and the plans they give."""

import random

import pytest
from pyspark.sql import Window, functions as F

from siteloom.operators import groups, hosts, scope


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 9)}", i * 3, rnd.choice("abc")) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, seq bigint, v string").cache()


@pytest.mark.parametrize("block", [7, 500, 10 ** 6])
def test_previous_in_group_equals_lag(skewed, block):
    got = groups.previous_in_group(skewed, ["k"], "seq", "v", "before", block)
    want = skewed.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("seq")))
    assert sorted(map(tuple, got.select("k", "seq", "v", "before").collect()), key=str) == sorted(
        map(tuple, want.select("k", "seq", "v", "before").collect()), key=str)


def test_top_n_equals_row_number(skewed):
    order = [F.col("v"), F.col("seq")]
    got = groups.top_n(skewed, ["k"], order, 5, rank="r")
    want = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("r <= 5")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_top_n_cuts_before_the_shuffle(skewed):
    plan = groups.top_n(skewed, ["k"], [F.col("seq")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_join_key_is_split_at_run_time(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60000, 1, 8).selectExpr(
            "CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS target", "'a' AS crawl_id", "id AS seq", "sha1(CAST(id AS STRING)) AS url")
        right = spark.range(0, 60000, 1, 8).selectExpr("CAST(id AS STRING) AS target", "'a' AS crawl_id").union(
            spark.sql("SELECT 'hot', 'a'"))
        joined = left.join(right, ["crawl_id", "target"], "left_semi")
        assert len(joined.collect()) == 60000
        joined.write.format("noop").mode("overwrite").save()
        df = left.join(right, ["crawl_id", "target"], "left_semi")
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_primary_host_first_seen_on_ties(spark):
    df = spark.createDataFrame([("c", 1, "https://b/x"), ("c", 2, "https://a/x"), ("c", 3, "https://a/y"), ("c", 4, "https://b/y")],
                               "crawl_id string, seq bigint, url string")
    assert hosts.primary_hosts(hosts.crawl_hosts(df)).first().primary_host == "b"


def test_allow_list(spark):
    df = spark.createDataFrame([("https://a.example.com/",), ("https://example.com/",), ("https://badexample.com/",)], "url string")
    allowed = spark.createDataFrame([("Example.com",)], "domain string")
    assert sorted(r.url for r in scope.host_allowed(df, allowed).collect()) == ["https://a.example.com/", "https://example.com/"]
    assert scope.host_allowed(df, allowed.where("false")).count() == 3

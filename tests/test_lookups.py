"""Findings kept for look-ups, and distinct counts from stored sketches."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import sketches as S
from siteloom.plans import findings_store as K


def rows_read(df):
    """Rows that the scan of a plan handed on, after row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    while plan.children().size() or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def findings(spark, n, crawl="one", num=7):
    # Addresses by hash: bounds of unsorted row groups would not help.
    return spark.range(n).select(
        F.lit(crawl).alias("crawl_id"), F.lit(num).alias("num"), F.lit(0).alias("rank"), F.col("id").alias("seq"), F.lit(0).alias("pos"),
        F.concat(F.lit("https://w/"), F.sha2(F.col("id").cast("string"), 256)).alias("url"), F.lit("crawl").alias("basis"))


def test_findings_of_a_url_read_few_rows(spark, tmp_path):
    path = str(tmp_path / "findings")
    both = findings(spark, 40_000).unionByName(findings(spark, 20_000, "one", 9))
    assert K.write_findings(both, path, row_group_bytes=64 << 10)
    stored = K.read_findings(spark, path, both.schema)
    assert stored.count() == 60_000
    url = findings(spark, 5).where("seq = 3").first().url
    hit = K.findings_of(stored, url)
    assert sorted((r.num, r.seq) for r in hit.collect()) == [(7, 3), (9, 3)]
    assert rows_read(K.findings_of(stored, url)) < 6_000
    # An address between others that does not occur: the filters of the row groups rule it out.
    assert rows_read(K.findings_of(stored, url[:-1] + "~")) <= 2_000
    assert K.findings_of(stored, url, "https://none/").count() == 2


def test_crawls_and_checks_are_replaced(spark, tmp_path):
    path = str(tmp_path / "findings")
    assert K.write_findings(findings(spark, 30, "007"), path) and K.write_findings(findings(spark, 10, "2", 8), path)
    assert K.write_findings(findings(spark, 4, "007"), path)
    counts = {(r.crawl_id, r.num): r["count"] for r in K.read_findings(spark, path).groupBy("crawl_id", "num").count().collect()}
    assert counts == {("007", 7): 4, ("2", 8): 10}
    assert not K.write_findings(findings(spark, 0), path) and K.read_findings(spark, path).count() == 14


def test_sketches_over_many_crawls(spark):
    links = spark.range(60_000).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("crawl_id"), F.concat(F.lit("p"), F.col("id") % 4_000).alias("url"),
        F.concat(F.lit("t"), F.col("id") % 25_000).alias("link"), F.when(F.col("id") % 2 == 0, F.lit("h")).alias("host"))
    kept = S.link_sketches(links)
    every = {r.measure: r.n for r in S.distinct_counts(kept).collect()}
    assert every["targets"] == pytest.approx(25_000, rel=0.02) and every["linking_pages"] == pytest.approx(4_000, rel=0.02)
    assert every["target_hosts"] == 1  # nulls do not count
    exact = {(r.crawl_id): r.n for r in links.groupBy("crawl_id").agg(F.countDistinct("link").alias("n")).collect()}
    got = {r.crawl_id: r.n for r in S.distinct_counts(kept.where("measure = 'targets'"), "crawl_id").collect()}
    assert got.keys() == exact.keys() and all(got[c] == pytest.approx(n, rel=0.02) for c, n in exact.items())
    assert S.distinct_counts(S.link_sketches(links.limit(0))).count() == 0


def test_image_sketches(spark):
    crawl = spark.sql("""SELECT 'a' AS crawl_id, array(named_struct('src', 'x', 'alt', ''), named_struct('src', 'y', 'alt', '')) AS images
                         UNION ALL SELECT 'b', array(named_struct('src', 'y', 'alt', 'k'))""")
    kept = S.image_sketches(crawl)
    assert {r.crawl_id: r.n for r in S.distinct_counts(kept, "crawl_id").collect()} == {"a": 2, "b": 1}
    assert [r.n for r in S.distinct_counts(kept).collect()] == [2]

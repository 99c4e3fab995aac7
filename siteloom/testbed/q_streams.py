"""Queries on reachability, rate limits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import analysis as A, pacing, reach as RE
from siteloom.session import new_path
from siteloom.streaming import progress
from siteloom.testbed import derived as D
from siteloom.testbed.registry import query

LIMIT, WINDOW_SEC = 2, 21600


@query("reach_depth", """SELECT crawl_id, url, min(depth) AS depth FROM walk GROUP BY ALL""", {
    "walk": """SELECT crawl_id, url, 0 AS depth FROM crawl WHERE depth = 0
        UNION SELECT w.crawl_id, l.link, w.depth + 1 FROM walk w JOIN links l ON l.crawl_id = w.crawl_id AND l.url = w.url WHERE w.depth < 3"""})
def reach_depth(spark, sf):
    c = D.stored(spark, sf)
    return RE.reach(A.link_facts(c), c.where("depth = 0").select("crawl_id", "url"), 3).withColumn(
        "depth", F.col("depth").cast("bigint"))


@query("rate_limit_attempts", f"""SELECT event_id, user_id, attempts, attempts > {LIMIT} AS over_limit FROM (SELECT event_id, user_id,
    count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_SEC * 1_000_000} PRECEDING AND CURRENT ROW) AS attempts FROM events)""")
def rate_limit_attempts(spark, sf):
    return pacing.attempts(D.read(spark, sf, "events"), "user_id", "ts", LIMIT, WINDOW_SEC).select(
        "event_id", "user_id", "attempts", "over_limit")


@query("rate_limit_sessions", f"""SELECT event_id, user_id, max(start) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM (
    SELECT event_id, user_id, us, CASE WHEN prev IS NULL OR us - prev > {WINDOW_SEC * 1_000_000} THEN us END AS start FROM (
    SELECT event_id, user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))""")
def rate_limit_sessions(spark, sf):
    """Runs of events of a user without a pause longer than the window."""
    rows = D.read(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return pacing.sessions(rows, "user_id", ["at", "event_id"], "at", WINDOW_SEC * 1_000_000, 24 * WINDOW_SEC * 1_000_000).select(
        "event_id", "user_id", "session")


@query("stream_progress", """SELECT crawl_id, coalesce(CAST(status AS STRING), 'null') AS status, count(*) AS pages FROM crawl GROUP BY ALL""")
def stream_progress(spark, sf):
    """Crawl rows arriving as rotated JSON parts; the counts after the last batch."""
    parts, sink = new_path(spark, "parts"), new_path(spark, "progress")
    D.stored(spark, sf).select("crawl_id", "url", "status").repartition(4).write.json(parts)
    stream = progress.read_parts(spark, parts, max_files=2)
    progress.follow(stream, new_path(spark, "progress-state"), sink).awaitTermination()
    return progress.latest(spark, sink)

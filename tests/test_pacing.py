"""Rate limits over recorded events, and the progress stream."""

from collections import defaultdict

from siteloom.operators import pacing
from siteloom.streaming import progress


def _events(spark):
    # Client 0 calls every few seconds, the others now and then.
    rows = [(i, i % 4 and i % 7, (i * i * 37) % 5000) for i in range(1200)]
    return spark.createDataFrame(rows, "id bigint, client bigint, sec bigint").selectExpr("*", "timestamp_seconds(sec) AS ts")


def test_attempts(spark):
    events = _events(spark)
    times = defaultdict(list)
    for r in events.collect():
        times[r.client].append(r.sec)
    for r in pacing.attempts(events, "client", "ts", 2, 60).collect():
        assert r.attempts == sum(r.sec - 60 <= t <= r.sec for t in times[r.client])
        assert r.over_limit == (r.attempts > 2)


def test_sessions(spark):
    got = defaultdict(set)
    for r in pacing.sessions(_events(spark), "client", ["sec", "id"], "sec", 30, 400).collect():
        got[r.client].add((r.sec, r.session))
    for pairs in got.values():
        start = before = None
        for sec, session in sorted(pairs):
            start = sec if before is None or sec - before > 30 else start
            assert session == start
            before = sec


def test_progress_counts_new_parts(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for size in (4, 1):
        spark.range(size).selectExpr("'c' AS crawl_id", "'u' AS url", "404L AS status").coalesce(1).write.mode("append").json(str(source))
        progress.follow(progress.read_parts(spark, str(source)), state, sink).awaitTermination()
    assert [(r.crawl_id, r.status, r.pages) for r in progress.latest(spark, sink).collect()] == [("c", "404", 5)]

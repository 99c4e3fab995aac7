"""Sliding-window rate limits over recorded events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def attempts(events: DataFrame, client: str, ts: str, limit: int, window_sec: float) -> DataFrame:
    """Each event with the attempts of its client in the window up to it; over the limit means refused.

    Counts refused attempts too. Kept to ranges of one window length: an event
    looks at its own range and the one before, so no client is one group.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = int(window_sec * 1_000_000)
    rows = events.withColumn("_at", micros).withColumn("_slot", F.expr(f"_at div {width}"))
    # An event counts in its own slot and in the next one.
    copies = rows.select(
        "*", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)).alias("_seen_in"),
    ).withColumn("_own", F.col("_seen_in") == F.col("_slot"))
    trailing = Window.partitionBy(client, "_seen_in").orderBy("_at").rangeBetween(-width, 0)
    counted = copies.withColumn("attempts", F.count("*").over(trailing)).where("_own")
    return counted.withColumn("over_limit", F.col("attempts") > limit).drop("_at", "_slot", "_seen_in", "_own")


def sessions(events: DataFrame, client: str, order: list[str], at: str, gap: int, block: int) -> DataFrame:
    """Adds ``session``: the start of the run of events with no pause longer than ``gap``.

    After such a pause nothing of a client's past counts any more, so sessions
    are independent. Starts are found inside time blocks and carried over the
    (client, block) summary, never over all events of a client at once.
    """
    blocked = events.withColumn("_block", F.expr(f"`{at}` div {block}"))
    inside = Window.partitionBy(client, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = blocked.withColumn("_prev", F.lag(at).over(inside))
    starts = F.when(F.col(at) - F.col("_prev") > gap, F.col(at))
    local = marked.withColumn("_start", F.last(starts, ignorenulls=True).over(upto))

    across = Window.partitionBy(client).orderBy("_block")
    ends = blocked.groupBy(client, "_block").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    last_start = local.groupBy(client, "_block").agg(F.max("_start").alias("_inner"))
    heads = ends.join(last_start, [client, "_block"]).withColumn("_before", F.lag("_last").over(across))
    opens = F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap), F.col("_first"))
    # The session a block begins in: opened here, or the latest start of the blocks before.
    heads = heads.withColumn("_opens", opens).withColumn("_latest", F.coalesce("_inner", "_opens"))
    prior = F.last("_latest", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = heads.withColumn("_carry", F.coalesce("_opens", prior)).select(client, "_block", "_carry")
    return local.join(carried, [client, "_block"], "left").withColumn(
        "session", F.coalesce("_start", "_carry")).drop("_block", "_prev", "_start", "_carry")

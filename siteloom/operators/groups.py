"""Group operations that stay parallel when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of one group that a single task may order.
BLOCK_ROWS = 1_000_000
_SPREAD = 64


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every group in the given total order.

    Each group is cut to ``n`` rows in many parts first, so the last ordering
    sees at most ``n`` rows per part however large the group is.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SPREAD))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n)
        .drop("_rank", "_part")
    )
    name = rank or "_rank"
    out = cut.withColumn(name, F.row_number().over(final)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def previous_in_group(
    df: DataFrame, keys: list[str], seq: str, value: str, out: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``lag(value)`` per group ordered by ``seq``, without ordering a whole group in one task.

    ``seq`` is unique within a group and is cut into ranges of ``block_rows``:
    rows look back inside their range, and the first row of a range takes the
    last value of the range before it. ``value`` must not be null.
    """
    blocked = df.withColumn("_block", F.expr(f"`{seq}` div {block_rows}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = (
        blocked.groupBy(*keys, "_block").agg(F.max_by(value, seq).alias("_last"))
        .withColumn("_before", F.lag("_last").over(across)).drop("_last")
    )
    return (
        blocked.withColumn("_inside", F.lag(value).over(inside))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_inside", "_before", "_block")
    )


def first_seen(df: DataFrame, keys: list[str], order: list[str], out: str = "first_seen") -> DataFrame:
    """Distinct keys with the smallest ordering tuple they were seen at."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias(out))

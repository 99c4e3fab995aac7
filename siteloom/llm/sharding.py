"""Extendible hashing of rows to shards of bounded bytes, in DataFrame operations only.

A row's key is the first 60 bits of the MD5 of its id. The directory starts with one shard at
depth 0; a shard over the byte limit splits on its next bit. The directory is computed from
the bytes of each prefix cell, level group by level group: a group adds ``STEP`` bits for the
cells of shards that are still too large and for nothing else, so the work past the first pass
follows what is oversized. Rows are counted per cell before anything is shuffled.

Defined cases: a null id hashes like the empty text; a null text has 0 bytes; rows with the
same id share a key, and a shard in which one key alone is over the limit cannot be split by
key: its rows are counted off into parts of rows of equal size. A single row over the limit
is a part of its own. Extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BITS = 60
#: Bits by which one round of the directory descends.
STEP = 12


def key(col: Column) -> Column:
    """60 hash bits as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Shards of the stored table ``rows(key, size)``: depth, prefix, shard_bytes, oversized.

    ``oversized`` marks shards at full depth whose single key is over the limit.
    """
    found, depth, todo = None, 0, None
    while depth < BITS:
        deep = min(BITS, depth + STEP)
        here = rows if todo is None else rows.withColumn("prefix", F.shiftright("key", BITS - depth)).join(todo, "prefix", "left_semi")
        fine = here.groupBy(F.shiftright("key", BITS - deep).alias("cell")).agg(F.sum("size").alias("size"))
        levels = materialise(
            fine.select("size", "cell", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
            .select("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix"), "size")
            .groupBy("depth", "prefix").agg(F.sum("size").alias("shard_bytes")), "shard_levels")
        big = levels.where(F.col("shard_bytes") > limit)
        fits = levels.where(F.col("shard_bytes") <= limit)
        # A shard is the first prefix on its path that fits: its parent does not.
        inner = big.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        new = (fits.where(F.col("depth") > depth).withColumn("up", F.shiftright("prefix", 1))
               .join(inner, ["depth", "up"], "left_semi").select("depth", "prefix", "shard_bytes"))
        found = new.unionByName(fits.where("depth = 0")) if found is None else found.unionByName(new)
        todo = big.where(F.col("depth") == deep).select("prefix", "shard_bytes")
        depth = deep
        if todo.isEmpty():
            return found.withColumn("oversized", F.lit(False))
        last, todo = todo, todo.select("prefix")
    return found.withColumn("oversized", F.lit(False)).unionByName(last.select(F.lit(BITS).alias("depth"), "prefix", "shard_bytes", F.lit(True).alias("oversized")))


def assign(df: DataFrame, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without ``text``, and shard (its bits, a part appended where one key was cut), depth, n_bytes, shard_bytes."""
    clash = {"shard", "depth", "n_bytes", "shard_bytes"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    own = [c for c in df.columns if c != text]
    rows = materialise(df.select(
        F.struct(*own).alias("row"), key(F.col(id_col)).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size")), "shard_rows")
    shards = materialise(directory(rows.select("key", "size"), limit), "shards")
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most BITS + 1 numbers
    # One prefix of a key is in the directory.
    marks = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("key", BITS - d).alias("prefix")) for d in depths]
                    or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))])
    placed = (rows.select("row", "key", "size", F.explode(marks).alias("m")).select("row", "key", "size", "m.*")
              .join(shards, ["depth", "prefix"])
              .withColumn("shard", F.expr(f"substring(lpad(bin(prefix), {BITS}, '0'), {BITS} + 1 - depth, depth)")))
    out = [F.col("row.*"), "shard", "depth", F.col("size").alias("n_bytes"), "shard_bytes"]
    if not shards.where("oversized").isEmpty():
        placed = _cut(placed, limit)
    return placed.select(*out)


def _cut(placed: DataFrame, limit: int) -> DataFrame:
    """Count the rows of oversized keys off into parts, without gathering a key in one task."""
    over = materialise(placed.where("oversized"), "oversized").withColumn("slice", F.spark_partition_id())
    same = ["shard", "size"]
    counts = over.groupBy(*same, "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*same).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (over.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "slice").orderBy(F.lit(0))))
            .join(counts.select(*same, "slice", before.alias("before")), [*same, "slice"]))
    room = F.greatest(F.floor(F.lit(limit) / F.greatest("size", F.lit(1))), F.lit(1))
    over = over.withColumn("part", F.floor((F.col("before") + F.col("nth") - 1) / room))
    sizes = over.groupBy(*same, "part").agg(F.sum("size").alias("part_bytes"))
    over = over.join(sizes, [*same, "part"]).withColumn("shard_bytes", F.col("part_bytes"))
    over = over.withColumn("shard", F.concat_ws("+", "shard", F.concat_ws(".", "size", "part")))
    return placed.where("NOT oversized").unionByName(over.select(placed.columns))

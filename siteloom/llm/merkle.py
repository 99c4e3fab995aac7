"""Merkle manifest of a table by slot pivots.

Rows are leaves; per group (source) they stand in id order, and every run of ``fanout`` nodes becomes the hash
of their concatenated hashes, until one is left: the group's subroot. Subroots, in group order, give the root in
the same way. One level is one slot pivot: conditional aggregates spread a parent's children over ``fanout``
columns; the columns joined give the parent's hash, and without a child's own slot they give its siblings.

Levels are worked in rounds. A block is the subtree of ``fanout ** levels`` neighbouring leaves; rows are dealt by
(tree, block), so all levels of a round need one shuffle of narrow rows, and a large group is many blocks. A round
leaves one node per block, and the next round works on those; what it finds above a block comes back by one join.
Texts are hashed where they are read and never shuffled. Places come from a range sort: a row's place in its
partition, and the counts of the partitions before. All steps are column expressions.

Defined cases: a null field is ``-``, an empty one ``0:``. Rows of one id are ordered by leaf hash; equal rows are
told apart by their place in storage, which no hash shows. A null id comes first in its group, a null group first
of all. A group of one row has its leaf as subroot, a table of one group its subroot as root. Texts may be long.
Other columns, whatever their names, are ignored unless named in ``fields`` or ``keep``. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Most leaves of one block.
BLOCK = 1000

SIBLINGS = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` if null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that ``leaf`` and its siblings lead to."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_text(siblings: Column) -> Column:
    """All sibling hashes, level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of the stored table ``rows(grp, ...)`` with tree (a number that ascends with grp), pos and n."""
    by = ["grp", *order, "_stored"]
    spread = (rows.withColumn("_stored", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
              .drop("_stored").withColumn("place", F.monotonically_increasing_id()))
    spread = materialise(spread.withColumn("part", F.shiftright("place", 33)), "ranked")
    stretches = spread.groupBy("grp", "part").agg(F.min("place").alias("lo"), F.count("*").alias("here"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select(
        F.col("grp").alias("g"), F.col("part").alias("p"), F.min("lo").over(whole).alias("tree"),
        (before - F.col("lo")).alias("shift"), F.sum("here").over(whole).alias("n"))
    return (spread.join(stretches, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
            .withColumn("pos", F.col("place") + F.col("shift")).drop("g", "p", "part", "place", "shift"))


def _slots(fanout: int, slot: Column) -> list[Column]:
    """The pivot of one level: a parent's children by slot."""
    return [F.max(F.when(slot == j, F.col("hash"))) for j in range(fanout)]


def _joined(columns: list[Column]) -> Column:
    return F.concat_ws("", *columns)


def prove(nodes: DataFrame, fanout: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes(tree, pos, n, hash, ...)`` with siblings up to the root, subroot and root.

    ``finish`` gets one node per tree, with its hash, and returns tree, pos, siblings, subroot and root.
    """
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    span = fanout ** levels
    dealt = nodes.withColumn("block", F.expr(f"pos div {span}")).repartition("tree", "block")

    up = dealt.select("tree", "block", "n", "pos", "hash")
    for level in range(levels):
        slots = _slots(fanout, F.col("pos") % fanout)
        names = [f"s{j}" for j in range(fanout)]
        up = (up.groupBy("tree", "block", "n", F.expr(f"pos div {fanout}").alias("pos"))
              .agg(*(s.alias(name) for s, name in zip(slots, names)))
              .withColumn("hash", F.when(F.col("n") > fanout ** level, F.sha2(_joined([F.col(x) for x in names]), 256)).otherwise(F.col("s0")))
              .drop(*names))
    tops = materialise(up.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), "hash"), "blocks")
    above = finish(tops) if tops.where("n > 1").isEmpty() else prove(tops, fanout, finish)
    above = above.select("tree", F.col("pos").alias("block"), F.col("siblings").alias("rest"), "subroot", "root")

    down = dealt.withColumn("node", F.col("hash")).join(above.hint("merge"), ["tree", "block"])
    steps = []
    for level in range(levels):
        names = [f"s{j}" for j in range(fanout)]
        slot = F.expr(f"pos div {fanout ** level} % {fanout}")
        down = down.withColumn("parent", F.expr(f"pos div {fanout ** (level + 1)}"))
        family = Window.partitionBy("tree", "block", "parent")
        down = down.withColumns({name: s.over(family) for name, s in zip(names, _slots(fanout, slot))})
        active = F.col("n") > fanout ** level
        left = _joined([F.when(slot > j, F.col(x)) for j, x in enumerate(names)])
        right = _joined([F.when(slot < j, F.col(x)) for j, x in enumerate(names)])
        steps.append(f"step{level}")
        down = down.withColumns({
            steps[-1]: F.when(active, F.struct(left.alias("left"), right.alias("right"))),
            "hash": F.when(active, F.sha2(_joined([F.col(x) for x in names]), 256)).otherwise(F.col("hash"))}).drop(*names)
    siblings = F.concat(F.array_compact(F.array(*steps)), "rest").cast(SIBLINGS)
    return down.withColumns({"siblings": siblings, "hash": F.col("node")}).drop("block", "parent", "node", "rest", *steps)


def _alone(tops: DataFrame) -> DataFrame:
    """The end of a climb: one node, nothing beside it."""
    return tops.select("tree", "pos", F.array().cast(SIBLINGS).alias("siblings"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             fanout: int = 3, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, grp, leaf, siblings (leaf level first), subroot, root and the expressions of ``keep``."""
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    keep = keep or {}
    leaves = materialise(docs.select(
        F.col(id_col).alias("id"), F.col(group).cast("string").alias("grp"), leaf_hash(*(F.col(f) for f in fields)).alias("hash"),
        *(value.alias(f"keep_{name}") for name, value in keep.items())), "leaves")

    def groups(tops: DataFrame) -> DataFrame:
        subroots = materialise(tops.select(F.lit("").alias("grp"), F.col("tree").alias("id"), F.col("hash")), "subroots")
        proved = prove(ranked(subroots, ["id"]), fanout, _alone)
        return materialise(proved.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("pos"), "siblings", F.col("hash").alias("subroot"), "root"), "groups")

    proved = prove(ranked(leaves, ["id", "hash"]), fanout, groups)
    return proved.select(
        "id", "grp", F.col("hash").alias("leaf"), "siblings", "subroot", "root", *(F.col(f"keep_{name}").alias(name) for name in keep))

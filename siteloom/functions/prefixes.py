"""Longest prefix of a text among many, found by binary search in a sorted array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def prefix_lists(rows: DataFrame, keys: list[str], prefix: str, value: str, others: list[str] | None = None) -> DataFrame:
    """Per ``keys``: ``prefixes``, the sorted array of the distinct texts of column ``prefix``, and a list for each of ``others``.

    An element is the text with its ``chain``: length and value of every listed text that it begins with, itself included.
    Of several values of one text the largest stands. Rows without a text add to ``others`` alone. Each text is spread over its own prefixes, which
    meet by equality; nothing is compared in pairs. An array is held in a row, so a key bounds it (the rules of one robots file).
    """
    others = others or []
    text, size = F.col(prefix), F.length(prefix)
    cuts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array(F.lit(0)))
    spread = rows.select(*keys, *others, prefix, value, F.explode(cuts).alias("_n")).withColumn("_head", text.substr(F.lit(1), F.col("_n")))
    met = spread.groupBy(*keys, *others, "_head").agg(
        F.max(F.when(F.col("_n") == F.coalesce(size, F.lit(0)), F.col(value))).alias("_value"),
        F.max(F.when(F.col("_n") == F.coalesce(size, F.lit(0)), True)).alias("_listed"),
        F.collect_set(prefix).alias("_owners")).where("_listed")
    chained = met.select(*keys, *others, "_head", "_value", F.explode_outer("_owners").alias("_owner")).groupBy(*keys, *others, "_owner").agg(
        F.array_sort(F.collect_list(F.struct(F.length("_head").alias("len"), F.col("_value").alias("value")))).alias("chain"))
    element = F.when(F.col("_owner").isNotNull(), F.struct(F.col("_owner").alias("text"), "chain"))
    return chained.groupBy(*keys).agg(
        F.array_sort(F.collect_list(element)).alias("prefixes"), *[F.collect_set(o).alias(o) for o in others])


def longest_prefix(prefixes: Column, target: Column) -> Column:
    """(len, value) of the longest text of ``prefixes`` that ``target`` begins with, null if none.

    The search ends at the last text that is not behind ``target``. Every listed text that ``target`` begins with is then
    a beginning of that one too, so it stands in its chain. The cost grows with the logarithm of the array.
    """
    n = F.size(prefixes)

    def halve(span, _):
        mid = F.shiftright(span["lo"] + span["hi"], 1)
        behind = F.get(prefixes, mid)["text"] > target
        return F.when(span["lo"] >= span["hi"], span).otherwise(F.struct(
            F.when(behind, span["lo"]).otherwise(mid + 1).alias("lo"), F.when(behind, mid).otherwise(span["hi"]).alias("hi")))

    place = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n))), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda span: span["lo"] - 1)
    # Looked up once: a lambda keeps the element found.
    return F.get(F.transform(F.array(F.get(prefixes, F.nullif(place, F.lit(-1)))), lambda found: F.array_max(F.filter(
        found["chain"], lambda c: F.startswith(target, F.left(found["text"], c["len"]))))), F.lit(0))

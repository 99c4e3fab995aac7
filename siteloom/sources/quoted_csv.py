"""CSV files with line breaks in cells, read split by split.

A line break belongs to a cell when an odd number of quotes stands before it in its file. Every split counts its quotes and, for
either parity at its begin, the records that begin in it; prefix sums over the splits, of which there are few,
then tell each line whether it begins a record and which one. Lines that are a whole record stay where they are; only lines of
records of several lines meet, by record. So a large file is read by many tasks.

Defined cases: the first record of every file is its header, that of the first file by name gives the column names; empty
lines between records are none; a file with a byte that is not UTF-8 is read as Latin-1, the others as UTF-8; a file whose quotes do
not pair is an error, since all its rest would be one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from siteloom.session import materialise

_OPTIONS = {"quote": '"', "escape": '"'}
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines: file, block (start of the split), row (ascending within it), value, quotes."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        "value", F.regexp_count("value", F.lit('"')).alias("quotes"))


def file_facts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file whether it is UTF-8, whether a cell of it holds a line break, and whether its quotes pair."""
    return text_lines(spark, paths).groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(F.col("quotes") % 2 == 1).alias("broken"), (F.sum("quotes") % 2 == 0).alias("paired"))


def read_csv(spark: SparkSession, paths: str | list[str], place: str) -> DataFrame:
    """All columns as text, null where blank, and ``place``: the record's number over all files by name, from 0."""
    facts = materialise(file_facts(spark, paths), "csv_files")
    odd = facts.where("NOT paired").select("file").orderBy("file").first()
    if odd:
        raise ValueError(f"quotes do not pair in {odd.file}")
    # Names stand in the first record; only that is read here.
    first = facts.orderBy("file").first()
    header = spark.read.csv(paths if first is None else first.file, header=True, inferSchema=False, encoding=UTF8 if first is None or first.utf8 else LATIN1, multiLine=True, **_OPTIONS)

    split = Window.partitionBy("file", "block").orderBy("row")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    lines = text_lines(spark, paths).withColumn("parity", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for p in (0, 1):
        lines = lines.withColumn(f"began{p}", F.count_if(F.col("parity") == p).over(split.rowsBetween(Window.unboundedPreceding, 0)))
    lines = materialise(lines, "csv_lines")

    # As many rows as there are splits.
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("began0").alias("began0"), F.max("began1").alias("began1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("carry", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("began", F.when(F.col("carry") == 0, F.col("began0")).otherwise(F.col("began1")))
    splits = splits.withColumn("shift", F.coalesce(F.sum("began").over(earlier), F.lit(0)))
    files = splits.groupBy("file").agg(F.sum("began").alias("records"))
    # One record of each file is its header.
    files = files.withColumn("first", F.coalesce(F.sum(F.col("records") - 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = materialise(splits.select("file", "block", "carry", "shift").join(files, "file").join(facts.select("file", "utf8"), "file"), "csv_splits")

    value = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), LATIN1))
    inside = F.col("parity") != F.col("carry")
    placed = lines.join(known, ["file", "block"]).select(
        "file", "block", "row", value.alias("value"), "first", (~inside & (F.col("quotes") % 2 == 0)).alias("whole"),
        (F.col("shift") + F.when(F.col("carry") == 0, F.col("began0")).otherwise(F.col("began1"))).alias("record"))
    parts = placed.where("NOT whole").groupBy("file", "record", "first").agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("lines"))
    joined = parts.select("file", "record", "first", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    records = placed.where("whole AND trim(value) <> ''").select("file", "record", "first", "value").unionByName(joined).where("record > 1")
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header.columns))])
    rows = records.select((F.col("first") + F.col("record") - 2).alias("_at"), F.from_csv("value", cells.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), _OPTIONS).alias("_row"))
    return rows.select(*(F.col("_row")[f"c{i}"].alias(name) for i, name in enumerate(header.columns)), F.col("_at").alias(place))

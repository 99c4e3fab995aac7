"""Crawl tables: JSON lines in, parquet in and out."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from siteloom import schema
from siteloom.operators.scope import image_scope

HEADER_SWEEP = T.StructType([f for f in schema.CRAWL if f.name in ("crawl_id", "seq", "url", "status", "resp_headers")])


def read_crawl_json(spark: SparkSession, path: str, crawl_id: str, columns: T.StructType | None = None) -> DataFrame:
    """Crawler output, one JSON object per line, under the crawl schema.

    Header and structured-data columns differ from crawl to crawl; pass the
    flat ``columns`` to skip the pass that finds them. Lines that are no JSON object, such as the cut last line of a
    crawl that was stopped, give no row; :func:`rejected_lines` lists them.
    """
    raw = _json_lines(spark, path, columns)
    # Numbered before the filter: a place counts the lines of the file.
    raw = raw if "seq" in raw.columns else numbered(raw, "seq")
    return schema.conform(raw.where(_rejected().isNull()).drop(REJECT), crawl_id)


#: Column that holds a line which is no JSON object.
REJECT = "_rejected_line"


def _json_lines(spark: SparkSession, path: str, columns: T.StructType | None) -> DataFrame:
    reader = spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", REJECT)
    found = reader.json(path).schema if columns is None else columns
    others = [f for f in found if f.name not in (REJECT, "url")]
    return reader.schema(T.StructType([*others, T.StructField("url", T.StringType()), T.StructField(REJECT, T.StringType())])).json(path)


def _rejected() -> Column:
    """The rejected line, null for a sound one. It names the address too, since Spark reads no rejected lines for their own sake alone."""
    return F.coalesce(F.col(REJECT), F.when(F.length("url") < 0, F.col("url")))


def rejected_lines(spark: SparkSession, path: str, crawl_id: str) -> DataFrame:
    """The lines of crawler output that give no row: crawl_id, file, place (from 0, over all files), raw, reason."""
    raw = _json_lines(spark, path, T.StructType([])).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata"))
    cut = F.trim(REJECT).startswith("{") & ~F.trim(REJECT).endswith("}")
    return numbered(raw, "place").where(_rejected().isNotNull()).select(
        F.lit(crawl_id).alias("crawl_id"), "file", "place", F.col(REJECT).alias("raw"), F.when(cut, "cut line").otherwise("not a JSON object").alias("reason"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row over all files of a file source: by file name, then by place in the file.

    Rows are counted per split; only the splits, not the rows, are put in order.
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row"))
    splits = marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are splits.
    offsets = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return marked.join(offsets, ["_file", "_block"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_file", "_block", "_row", "_shift")


def read_header_sweep(spark: SparkSession, path: str, crawl_id: str, columns: T.StructType | None = None) -> DataFrame:
    """A HEAD-only crawl: address, status and headers."""
    return read_crawl_json(spark, path, crawl_id, columns).select(*HEADER_SWEEP.names)


def read_image_shards(spark: SparkSession, folder: str, min_width: int = 0, min_height: int = 0,
                      include_img_regex: str | None = None) -> DataFrame:
    """All JSON-lines shards of an image crawl as one table; empty shards add nothing."""
    return image_scope(spark.read.option("pathGlobFilter", "*.{jl,json,jsonl}").json(folder), min_width, min_height, include_img_regex)


#: Folder of a store that notes the columns of each write; readers of the data pass over names of this form.
COLUMNS = "_columns"


def _stored_columns(spark: SparkSession, path: str) -> list[T.StructField]:
    """Columns of all writes to a store, of all files where they are not noted."""
    try:
        noted = [r.value for r in spark.read.schema("value string").text(f"{path}/{COLUMNS}").distinct().collect()]  # one row per kind of write
    except AnalysisException:
        return spark.read.option("mergeSchema", True).parquet(path).schema.fields
    found: dict[str, T.StructField] = {}
    for field in (f for text in sorted(noted) for f in T.StructType.fromJson(json.loads(text))):
        if found.setdefault(field.name, field).dataType != field.dataType:
            raise ValueError(f"column {field.name} is of two kinds in {path}")
    return list(found.values())


def write_crawl(crawl: DataFrame, path: str, partitioned: bool = True) -> bool:
    """Write the crawls of a table to a store; nothing is written for an empty one. Returns whether files were written.

    A store holds many crawls, one folder each. Those that occur in ``crawl`` are replaced as a whole, all others stay as they are;
    crawls may have columns of their own. An unpartitioned file is written once. What columns were written is noted beside the
    data, so that reading need not open every file; a column stays known when the crawl that had it is replaced.
    """
    if crawl.isEmpty():
        return False
    if partitioned:
        crawl.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id").parquet(path)
        spark = crawl.sparkSession
        spark.createDataFrame([(crawl.schema.json(),)], "value string").coalesce(1).write.mode("append").text(f"{path}/{COLUMNS}")
    else:
        crawl.write.parquet(path)
    return True


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """A stored crawl with all its columns; ``crawl_id`` filters prune whole folders.

    Columns of several crawls are brought together: one that a crawl lacks is null in its rows. A column of two
    kinds is an error.
    """
    others = [f for f in _stored_columns(spark, path) if f.name not in schema.CRAWL.names]
    kinds = T.StructType([*schema.CRAWL.fields, *others])
    return spark.read.schema(kinds).parquet(path).select(*(f"`{name}`" for name in kinds.names))


def write_side_table(df: DataFrame, path: str) -> str | None:
    """Analysis rows as parquet, skipped when empty."""
    if df.isEmpty():
        return None
    df.write.parquet(path)
    return path


def write_detail_csv(report: DataFrame, path: str) -> None:
    """The detail report as CSV files with a header."""
    report.drop("crawl_id", "seq").write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

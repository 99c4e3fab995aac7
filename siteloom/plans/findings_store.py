"""Findings kept for look-ups: by check, by crawl and by URL.

One folder per crawl and check, so that those two prune files. Inside a folder rows are sorted by URL and each
row group carries a bloom filter of its URLs: "all findings of this URL" reads the few row groups that may hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bytes of a row group before compression. Small groups make a look-up of one URL cheap.
ROW_GROUP_BYTES = 4 << 20
#: Rows of a file; a check that nearly every page fails gives many files, written by many tasks.
FILE_ROWS = 2_000_000
#: What a filter is sized for (distinct URLs of a row group) and how often it may answer in vain.
FILTER_URLS, FILTER_ERROR = 50_000, 0.01


def write_findings(findings: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> bool:
    """Store the findings of an audit; crawls and checks that occur are replaced, others stay. Returns whether any were written.

    Rows are dealt by ranges of crawl, check and URL: a check with a third of all findings is cut into as many ranges
    as it needs, and every file covers a range of URLs of its own.
    """
    if findings.isEmpty():
        return False
    order = ["crawl_id", "num", "url"]
    rows = findings.repartitionByRange(*order).sortWithinPartitions(*order)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.size", row_group_bytes)
     .option("parquet.bloom.filter.enabled#url", "true").option("parquet.bloom.filter.expected.ndv#url", FILTER_URLS)
     .option("parquet.bloom.filter.fpp#url", FILTER_ERROR).option("parquet.enable.dictionary#url", "false")
     .partitionBy("crawl_id", "num").parquet(path))
    return True


def read_findings(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All stored findings; filters on crawl and check prune folders.

    Without the schema it is taken from the files, crawls being named by text, also where the text is a number.
    """
    if schema is None:
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "crawl_id" else f for f in spark.read.parquet(path).schema])
    return spark.read.schema(schema).parquet(path)


def findings_of(stored: DataFrame, *urls: str) -> DataFrame:
    """Findings of a few URLs, over all crawls and checks. The predicate reaches the row groups' bounds and filters."""
    return stored.where(F.col("url").isin(*urls) if len(urls) > 1 else F.col("url") == urls[0])

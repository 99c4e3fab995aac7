"""Link-following reachability: which pages a crawl of given depth would visit."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from siteloom.session import new_path

_KEY = ["crawl_id", "url"]


class Buckets:
    """Tables of one walk, dealt to buckets of (crawl_id, url), as many as a shuffle has partitions.

    Tables dealt alike meet bucket by bucket, so a join moves neither. Their names stand in the session's
    catalogue until :meth:`forget` is called; the files stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # With fewer buckets than a shuffle begins with, Spark would deal the tables anew.
        first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        self.count = int(first or spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []

    def write(self, df: DataFrame, label: str) -> tuple[DataFrame, str, int]:
        """The table, its path and its number of rows. ``df`` comes dealt out by the key, so a bucket is one file."""
        name, path, rows = f"siteloom_{label}_{uuid.uuid4().hex}", new_path(self.spark, label), Observation()
        self.names.append(name)
        df.observe(rows, F.count("*").alias("n")).write.option("path", path).bucketBy(self.count, *_KEY).sortBy(*_KEY).saveAsTable(name)
        return self.spark.table(name), path, rows.get["n"]

    def deal(self, df: DataFrame) -> DataFrame:
        """Distinct rows dealt to the buckets' places by one shuffle."""
        return df.repartition(self.count, *_KEY).dropDuplicates()

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


#: As many tables of visited pages are made one.
FAN = 8


class Visited:
    """Tables of the pages met so far, merged in rounds: a page is written again once for every power of ``FAN`` levels."""

    def __init__(self, buckets: Buckets):
        self.buckets = buckets
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, level: DataFrame) -> None:
        rank, table = 0, level
        while [r for r, _ in self.tables].count(rank) == FAN - 1:
            same = [t for r, t in self.tables if r == rank]
            self.tables = [(r, t) for r, t in self.tables if r != rank]
            for t in same:
                table = table.unionByName(t)
            table, _, _ = self.buckets.write(self.buckets.deal(table), "visited")
            rank += 1
        self.tables.append((rank, table))

    def without(self, pages: DataFrame) -> DataFrame:
        for _, known in self.tables:
            pages = pages.join(known, _KEY, "left_anti")
        return pages


def next_level(edges: DataFrame, level: DataFrame, visited: Visited) -> DataFrame:
    """(crawl_id, url): targets of the pages of ``level`` that were not met before.

    Edges, levels and visited pages lie in buckets of the join key, so only the targets are shuffled.
    """
    return visited.without(edges.join(level, _KEY, "left_semi").select("crawl_id", F.col("target").alias("url")).distinct())


def reach(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(crawl_id, url, depth) reachable from seeds(crawl_id, url) over links(crawl_id, url, link).

    Breadth first, one join per level; a page keeps the depth it is first seen
    at. The edges are shuffled once, into buckets of their page; after that a level moves the targets of the
    links it follows and nothing else. Every level is written to the shared folder. Scope filters
    (``scope.crawl_scope`` on the ``link`` column) are applied to ``links`` before the walk, so it stays in
    the site. A seed without an address is kept and leads nowhere; links without a target are not followed.
    """
    spark = links.sparkSession
    buckets = Buckets(spark)
    try:
        followed = links.select(*_KEY, F.col("link").alias("target")).dropna()
        edges, _, _ = buckets.write(buckets.deal(followed), "edges")
        visited = Visited(buckets)
        level, path, found = buckets.write(buckets.deal(seeds.select(*_KEY)), "level")
        paths, kinds = [path], level.schema
        while found and len(paths) <= max_depth:
            visited.add(level)
            level, path, found = buckets.write(next_level(edges, level, visited), "level")
            paths.append(path)
    finally:
        buckets.forget()
    levels = [spark.read.schema(kinds).parquet(p).withColumn("depth", F.lit(d)) for d, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, levels)

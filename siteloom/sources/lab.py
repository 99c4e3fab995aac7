"""Lab-metric payloads and headless-render metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.functions.constants import LAB_AUDIT_IDS

_PAYLOAD = "lighthouseResult struct<audits: map<string, struct<score: double, numericValue: double>>>"
RENDER_METRICS = (
    "crawl_id string, url string, ok boolean, error string, page_errors array<string>, console_errors array<string>, "
    "title_at_load string, title_after_wait string, rendered_text_len bigint, rendered_links array<string>, "
    "nav_link_count bigint, hidden_text_len bigint, pseudo_content_count bigint, overlay boolean"
)


def lab_metrics(payloads: DataFrame) -> DataFrame:
    """payloads(crawl_id, url, payload) to (crawl_id, url, audit_id, score, numeric_value), known audits only."""
    parsed = payloads.select("crawl_id", "url", F.from_json("payload", _PAYLOAD).alias("p"))
    rows = parsed.select("crawl_id", "url", F.explode("p.lighthouseResult.audits").alias("audit_id", "a"))
    return rows.where(F.col("audit_id").isin(*LAB_AUDIT_IDS)).select(
        "crawl_id", "url", "audit_id", F.col("a.score").alias("score"), F.col("a.numericValue").alias("numeric_value"))


def read_render_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Render metrics as JSON lines; failed renders keep ok = false."""
    return spark.read.schema(RENDER_METRICS).json(path).withColumn("ok", F.coalesce("ok", F.lit(False)))

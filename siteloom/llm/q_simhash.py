"""op12: SimHash components of documents."""

from pyspark.sql import functions as F

from . import simhash
from .registry import query, table


@query("op12_simhash_near_dedup")
def op12(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""op6: licence phrases and notices of documents."""

from . import license_scan
from .registry import query, table


@query("op6_license_scan")
def op6(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

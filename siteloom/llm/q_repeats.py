"""op8: documents without repeated byte strings."""

from . import repeats
from .registry import query, table


@query("op8_suffix_array_dedup")
def op8(spark, sf_dir):
    return repeats.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))

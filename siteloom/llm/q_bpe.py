"""op9: BPE round trip of every document."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe
from .registry import query, table


def round_trip(docs, path):
    return bpe.encode_decode(docs.select("doc_id", "text"), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_bpe_round_trip")
def op9(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""op1: near-duplicate components of documents."""

from . import minhash
from .registry import query, table


@query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)

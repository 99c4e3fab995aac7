"""op10: shards of documents by extendible hashing."""

from . import sharding
from .registry import query, table

#: Bytes of text a shard may hold.
LIMIT = 1 << 20

SQL = f"""
WITH r AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k,
         coalesce(strlen(text), 0) AS n FROM documents),
s AS (
  SELECT d, k >> CAST(60 - d AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS b
  FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY 1, 2),
f AS (
  SELECT r.doc_id, r.k, r.n, min(s.d) AS depth FROM r JOIN s ON (r.k >> CAST(60 - s.d AS BIGINT)) = s.p AND s.b <= {LIMIT} GROUP BY 1, 2, 3)
SELECT f.doc_id, CAST(f.depth AS INTEGER) AS depth, CAST(f.n AS BIGINT) AS n_bytes, s.b AS shard_bytes,
       substr(lpad(bin(s.p), 60, '0'), 61 - CAST(f.depth AS INTEGER), CAST(f.depth AS INTEGER)) AS shard
FROM f JOIN s ON s.d = f.depth AND s.p = (f.k >> CAST(60 - f.depth AS BIGINT))
"""


@query("op10_sharding", SQL)
def op10(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), LIMIT)

"""op13: Merkle manifest of documents, with proofs checked against tampered rows."""

from pyspark.sql import functions as F

from . import merkle
from .registry import query, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str) -> str:
    values = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


# CRC-32 of the decimal id, byte by byte and bit by bit.
CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295))"""

TEXT = f"CASE WHEN ({CRC}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"


def _climb(name: str, base: str) -> str:
    """Levels of all trees of ``base(g, p, n, h)``, and beside each node its siblings to the left and right."""
    return f"""
{name} AS (
  SELECT 0 AS l, g, p, n, h FROM {base}
  UNION ALL
  SELECT l + 1, g, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM {name} WHERE n > 1 GROUP BY l, g, p // 3, (n + 2) // 3),
{name}_beside AS (
  SELECT u.l, u.g, u.p, u.n, coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p < u.p), '') AS lft,
         coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p > u.p), '') AS rgt
  FROM {name} u JOIN {name} v ON u.l = v.l AND u.g IS NOT DISTINCT FROM v.g AND u.p // 3 = v.p // 3 WHERE u.n > 1 GROUP BY ALL)"""


SQL = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(f'({TEXT})')} AS tampered FROM documents),
leaves AS (
  SELECT row_number() OVER () AS r, source AS g, doc_id, leaf, tampered, leaf AS h, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM hashed),
{_climb('up', 'leaves')},
subs AS (SELECT g AS source, 0 AS g, h, count(*) OVER () AS n, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM up WHERE n = 1),
{_climb('top', 'subs')},
walk AS (
  SELECT r, 0 AS l, g, p, n, tampered AS f, '' AS proof FROM leaves
  UNION ALL
  SELECT w.r, w.l + 1, w.g, w.p // 3, (w.n + 2) // 3, sha256(b.lft || w.f || b.rgt), w.proof || b.lft || b.rgt
  FROM walk w JOIN up_beside b ON w.l = b.l AND w.g IS NOT DISTINCT FROM b.g AND w.p = b.p),
walk2 AS (
  SELECT w.r, 0 AS l, s.p, s.n, w.f, w.proof FROM walk w JOIN subs s ON w.g IS NOT DISTINCT FROM s.source WHERE w.n = 1
  UNION ALL
  SELECT w.r, w.l + 1, w.p // 3, (w.n + 2) // 3, sha256(b.lft || w.f || b.rgt), w.proof || b.lft || b.rgt
  FROM walk2 w JOIN top_beside b ON w.l = b.l AND w.p = b.p)
SELECT v.doc_id, v.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified
FROM leaves v JOIN walk2 w ON v.r = w.r AND w.n = 1 JOIN subs s ON v.g IS NOT DISTINCT FROM s.source, top t WHERE t.n = 1
"""


@query("op13_merkle_manifest", SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = merkle.leaf_hash(*(altered if f == "text" else F.col(f) for f in FIELDS))
    found = merkle.manifest(docs, fields=FIELDS, fanout=3, keep={"tampered": tampered})
    folded = merkle.fold(F.col("tampered"), F.col("siblings"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("siblings")), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))

"""op4: pages through WARC archives and their capture index."""

from . import warc
from .registry import query, table


# Five hex digits are four base32 letters.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGEST = " || ".join(
    f"substr('{LETTERS}', 1 + CAST(((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31) AS INTEGER), 1)"
    for i in range(8) for s in (15, 10, 5, 0))

SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY 1, 2)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, {DIGEST} AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM p JOIN f USING (h, n)
"""


@query("op4_warc_round_trip", SQL)
def op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

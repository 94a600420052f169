"""Queries of this subpackage, by name, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidalspan.llm import lz_fingerprint, mixing, mtree, packing, secret_scan, simhash, substring, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_lz_fingerprint": lz_fingerprint.op1,
        "op2_mixing_tree": mixing.op2,
        "op3_url_filter": url_filter.op3,
        "op4_mtree_search": mtree.op4,
        "op5_substring_index": substring.op5,
        "op6_simhash_tiles": simhash.op6,
        "op7_warc_shards": warc.op7,
        "op8_harmonic_packing": packing.op8,
        "op9_toxicity_machine": toxicity.op9,
        "op10_secret_scan": secret_scan.op10,
    }


#: floor(256 * x) of each vector, and every pair of a query and another row.
OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + d AS j FROM dup, range(0, 20) r(d)
), word AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Base32 of a digest: five bits at a time out of its hexadecimal digits.
OP7 = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h || '00', (5 * i) // 4 + 1, 3))::BIGINT >> (7 - (5 * i) % 4)) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    """SQL for whole tables; the others are tested against brute force in tests/llm."""
    return {"op4_mtree_search": OP4, "op5_substring_index": OP5, "op7_warc_shards": OP7}

"""op4: pages from legacy archives to WARC and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.registry import query
from riskframe.llm.warc import archive_pages

SQL = """
WITH bytes AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || substr(h, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER]), '') AS payload_digest
  FROM bytes
), leads AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS lead FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM leads
"""


@query("op4_arc_to_warc", SQL)
def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read_table(spark, sf_dir, "pages"))

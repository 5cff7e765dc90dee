"""op10: documents into 40 shards by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.registry import query
from riskframe.llm.sharding import assign_shards

#: CRC-32 over the bytes of a blob, by the table method.
SQL = """
WITH RECURSIVE steps AS (
  SELECT n::UINTEGER AS n, n::UINTEGER AS c, 0 AS i FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), hashed AS (
  SELECT r, doc_id, octet_length(encode(text))::BIGINT + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UINTEGER)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS text_crc32,
    coalesce(xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::UINTEGER)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER)::BIGINT, -1) AS id_crc
  FROM docs CROSS JOIN crc
), walk AS (
  SELECT r, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS k, 0::BIGINT AS b, 0::BIGINT AS j, 0::BIGINT AS shard
  FROM docs
  UNION ALL
  SELECT r, nk, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nk // 8589934592) + 1)::DOUBLE))::BIGINT,
    CASE WHEN j < 40 THEN j ELSE shard END
  FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS nk FROM walk WHERE j <= 40)
), ends AS (SELECT r, max(b) AS grown, max(shard) AS shard FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY id_crc, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM hashed JOIN ends USING (r)
"""


@query("op10_jump_shards", SQL)
def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), shards=40)

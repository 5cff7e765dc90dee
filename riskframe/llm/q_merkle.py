"""op12: a Merkle manifest of all documents, with a proof for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.merkle import document_manifest
from riskframe.llm.registry import query

#: Levels of each tree as lists of lists; a proof reads the sibling of its index on every level.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT n::UINTEGER AS n, n::UINTEGER AS c, 0 AS i FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8
), fields AS (
  SELECT doc_id, lang, n_chars, xor(list_reduce(list_prepend(4294967295::UINTEGER,
      list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::UINTEGER)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER) AS id_crc,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(octet_length(encode((n_chars::HUGEINT + 1)::VARCHAR)) || ':' || (n_chars::HUGEINT + 1), '-') AS more,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents CROSS JOIN crc
), leaves AS (
  SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
    sha256(head || CASE WHEN id_crc % 7 = 0 THEN more ELSE chars END || tail) AS again FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves
), trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY r) AS l FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))
  FROM trees WHERE len(l) > 1
), by_lang AS (
  SELECT lang, max(level) AS depth, list(l ORDER BY level) AS ls, arg_max(l[1], level) AS subroot FROM trees GROUP BY lang
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY lang NULLS FIRST) AS l FROM by_lang
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM top WHERE len(l) > 1
), tops AS (SELECT max(level) AS top_depth, list(l ORDER BY level) AS ts, arg_max(l[1], level) AS root FROM top
), langs AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lr FROM by_lang CROSS JOIN tops
), paths AS (
  SELECT p.doc_id, p.leaf, p.again, l.subroot, l.root,
    list_concat(
      list_transform(range(0, l.depth), lambda k: CASE WHEN (r >> k::INTEGER) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(ls[k + 1][xor(r >> k::INTEGER, 1) + 1], '')),
      list_transform(range(0, l.top_depth), lambda k: CASE WHEN (lr >> k::INTEGER) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(ts[k + 1][xor(lr >> k::INTEGER, 1) + 1], ''))
    ) AS path
  FROM placed p JOIN langs l ON p.lang IS NOT DISTINCT FROM l.lang
), folded AS (
  SELECT *, list_reduce(list_prepend(again, path), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM folded
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(read_table(spark, sf_dir, "documents"))

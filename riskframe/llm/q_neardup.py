"""op7: near-duplicate documents on 2-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.neardup import near_duplicates
from riskframe.llm.registry import query

#: All pairs of distinct shingle sets that share a shingle, and their transitive closure.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (SELECT c, n, unnest(s) AS x FROM classes
), common AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM common UNION ALL SELECT b, a FROM common
), reach AS (SELECT c AS node, c AS seen FROM classes UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(k.component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.s = s.s AND c.n > 0 LEFT JOIN components k ON k.node = c.c
"""


@query("op7_tensored_minhash", SQL)
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")

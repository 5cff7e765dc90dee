"""op6: maximal conversations, rendered turn by turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.chats import format_chats
from riskframe.llm.common import read_table
from riskframe.llm.registry import query

SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY place) AS l FROM placed GROUP BY conv_id
), proper AS (SELECT DISTINCT k AS n, l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM whole)
), kept AS (SELECT min(conv_id) AS conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.n = whole.n AND p.l = whole.l) GROUP BY n, l)
SELECT p.conv_id, place, n_turns, role,
  '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<\|im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<\|im_') || '<|im_end|>' || chr(10) AS rendered
FROM placed p JOIN kept ON kept.conv_id IS NOT DISTINCT FROM p.conv_id
"""


@query("op6_snapshot_chats", SQL)
def op6_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))

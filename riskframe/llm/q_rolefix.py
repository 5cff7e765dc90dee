"""op13: damaged conversations, repaired at the least cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.registry import query
from riskframe.llm.rolefix import repaired_conversations


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A stack after one more edit; null where there is no such stack."""
    out = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}} END"


def _best(*stacks: str) -> str:
    return f"list_min(list_filter([{', '.join(stacks)}], lambda x: x IS NOT NULL))"


def _turn() -> str:
    """The four stacks after a turn, before inserts."""
    free, kept = "fault IS NULL OR fault = 'truncated'", "role || ':' || txt"
    own = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"

    def taken(state: str, initial: str, name: str) -> list[str]:
        keep = f"CASE WHEN ({free}) AND initial = '{initial}' THEN {_edit(state, own, 'K', kept)} END"
        move = f"CASE WHEN {free} THEN {_edit(state, own + ' + 1', 'R', repr(name + ':') + ' || txt')} END"
        return [keep] if initial == "s" else [keep, move]

    after = {
        "s0": [_edit("s0", "2", "D")],
        "s1": [_edit("s1", "2", "D"), *taken("s0", "s", "system")],
        "s2": [_edit("s2", "2", "D"), *taken("s0", "u", "user"), *taken("s1", "u", "user"), *taken("s3", "u", "user")],
        "s3": [_edit("s3", "2", "D"), *taken("s2", "a", "assistant")],
    }
    return ", ".join(f"{_best(*stacks)} AS {name}" for name, stacks in after.items())


_USER = _best("s2", *[_edit(s, "5", "I", "'user:'") for s in ("s0", "s1", "s3")])
_ASSISTANT = _best("s3", _edit("s2", "5", "I", "'assistant:'"))
_NONE = "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"

#: Four stacks per conversation, carried turn by turn as structs, so that the least of several is the least cost, then audit.
SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT n::UINTEGER AS n, n::UINTEGER AS c, 0 AS i FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8
), held AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    xor(list_reduce(list_prepend(4294967295::UINTEGER,
      list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::UINTEGER)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER) % 20 AS kind
  FROM conversations CROSS JOIN crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM held WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(txt), copy) AS r,
    regexp_replace(txt, '[\x20\x09-\x0D]+$', '') AS bare FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY r) > 1 AS again,
    role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY r) AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed
), turns AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), stacks AS (
  SELECT conv_id, 0::BIGINT AS r, s0, s1, s2, {_ASSISTANT} AS s3 FROM (
    SELECT conv_id, s0, s1, {_USER} AS s2, s3 FROM (
      SELECT conv_id, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM counts))
  UNION ALL
  SELECT conv_id, r, s0, s1, s2, {_ASSISTANT} AS s3 FROM (
    SELECT conv_id, r, s0, s1, {_USER} AS s2, s3 FROM (
      SELECT t.conv_id, t.r, {_turn()} FROM stacks s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.r = s.r + 1))
), ends AS (
  SELECT s.conv_id, {_best("s0", "s3")} AS best FROM stacks s JOIN (SELECT conv_id, max(r) AS n FROM turns GROUP BY conv_id) m
    ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.r
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op13_glr_repair", SQL)
def op13_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(read_table(spark, sf_dir, "conversations"))

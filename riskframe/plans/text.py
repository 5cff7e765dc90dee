"""Queries on file texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions import licenses, paths
from riskframe.functions import text as T
from riskframe.operators import textscan
from riskframe.plans.registry import query
from riskframe.sources import files as S
from riskframe.sources.adapters import adapt, table

LINES_SQL = r"""lined AS (SELECT repo_id, path, doc_id, unnest(parts) AS line_text, unnest(range(1, len(parts) + 1)) AS line FROM
      (SELECT *, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts FROM (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS p FROM files)))"""
ASSIGNMENT = r"(?i)\b((?:api[_-]?key|secret|token|password|passwd|authorization)[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9/+_\-]{12,})"
ASSIGNMENT_SQL = ASSIGNMENT.replace("'", "''")


@query("file_lines", f"WITH {LINES_SQL} SELECT path, line, sha256(line_text) AS line_hash FROM lined", uses=("files",))
def file_lines(spark, sf_dir):
    return S.lines(adapt(spark, sf_dir, "files")).select("path", "line", F.sha2("line_text", 256).alias("line_hash"))


@query(
    "secret_scan",
    f"""WITH {LINES_SQL}, hits AS (SELECT repo_id, path, line, unnest(regexp_extract_all(line_text, '{ASSIGNMENT_SQL}', 2)) AS v FROM lined)
    SELECT repo_id, path, line, 'secret.generic_assignment' AS rule_id, v[1:4] || repeat('*', length(v) - 8) || v[-4:] AS masked, 'high' AS severity FROM hits""",
    uses=("files",),
)
def secret_scan(spark, sf_dir):
    return textscan.secret_scan(adapt(spark, sf_dir, "files"))


@query(
    "secret_placeholders",
    rf"""WITH {LINES_SQL}, hits AS (SELECT repo_id, path, line, line_text, unnest(regexp_extract_all(line_text, '{ASSIGNMENT_SQL}', 2)) AS v FROM lined),
    near AS (SELECT h.path, h.line, h.v, string_agg(l.line_text, chr(10) ORDER BY l.line) AS ctx FROM hits h JOIN lined l ON l.path = h.path AND l.line BETWEEN h.line - 3 AND h.line + 1 GROUP BY ALL)
    SELECT path, line, v[1:4] || repeat('*', length(v) - 8) || v[-4:] AS masked,
      regexp_matches(v, '{textscan.PLACEHOLDER_WORDS}') OR regexp_matches(ctx, '{textscan.PLACEHOLDER_WORDS}') AS is_placeholder FROM near""",
    uses=("files",),
)
def secret_placeholders(spark, sf_dir):
    judged = textscan.placeholder_judgement(adapt(spark, sf_dir, "files"))
    return judged.select("path", "line", "masked", "is_placeholder").distinct()


def _redaction_sql(column: str) -> str:
    out = column
    for _name, pattern, keep, tail in C.REDACTIONS:
        replacement = ("\\1" if keep else "") + C.REDACTED + tail
        escaped = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{escaped}', '{replacement}', 'g')"
    return out


@query(
    "redact_documents",
    f"SELECT doc_id, sha256({_redaction_sql('text')}) AS redacted_hash, {_redaction_sql('text')} <> text AS changed FROM documents",
)
def redact_documents(spark, sf_dir):
    redacted = table(spark, sf_dir, "documents").select("doc_id", "text", T.redact(F.col("text")).alias("redacted"))
    return redacted.select(
        "doc_id", F.sha2("redacted", 256).alias("redacted_hash"), (F.col("redacted") != F.col("text")).alias("changed")
    )


@query(
    "mask_values",
    """SELECT page_id, CASE WHEN length(url) <= 8 THEN repeat('*', length(url)) ELSE url[1:4] || repeat('*', length(url) - 8) || url[-4:] END AS masked,
      'https://' || CASE WHEN length(url) - length(replace(url, '/', '')) >= 2 THEN split_part(url, '/', 3) ELSE 'webhook' END || '/…' || url[-4:] AS target FROM pages""",
)
def mask_values(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.mask(url).alias("masked"), T.mask_webhook(F.lit("slack"), url).alias("target")
    )


@query(
    "wrapped_untrusted_text",
    f"""WITH b AS (SELECT doc_id, {_redaction_sql('text')} AS body FROM documents)
    SELECT doc_id, sha256('<<<UNTRUSTED_REPOSITORY_DATA label="doc ' || doc_id || '"' || chr(10) || CASE WHEN length(body) > 500 THEN left(body, 500) || chr(10) || '...[truncated ' || (length(body) - 500) || ' chars]' ELSE body END
      || chr(10) || 'UNTRUSTED_REPOSITORY_DATA>>>') AS wrapped_hash FROM b""",
)
def wrapped_untrusted_text(spark, sf_dir):
    label = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(T.wrap_untrusted(label, F.col("text"), 500), 256).alias("wrapped_hash")
    )


SIGNAL_PATTERNS = C.INJECTION_PATTERNS + (
    ("pair_of_words", r"(?i)(^| )for .{0,40} with( |$)"),
    ("word_and_word", r"(?i)(^| )(the|der|les|los) .{0,20}(and|und|des|que)( |$)"),
)


def _signals_sql() -> str:
    matched = " UNION ALL ".join(
        f"SELECT repo_id, path, '{n}' AS pattern, line, line_text FROM w WHERE regexp_matches(line_text, '{p}') OR regexp_matches(pair, '{p}')"
        for n, p in SIGNAL_PATTERNS
    )
    return f"""{LINES_SQL}, w AS (SELECT *, CASE WHEN nxt IS NULL THEN line_text ELSE line_text || ' ' || nxt END AS pair FROM
        (SELECT *, lead(line_text) OVER (PARTITION BY path ORDER BY line) AS nxt FROM lined)),
      m AS ({matched}),
      r AS (SELECT *, line - row_number() OVER (PARTITION BY path, pattern ORDER BY line) AS run FROM m),
      signals AS (SELECT repo_id, path, pattern, line FROM (SELECT *, row_number() OVER (PARTITION BY path, pattern, run ORDER BY line) AS nth FROM r) WHERE nth % 2 = 1)"""


@query("injection_signals", f"WITH {_signals_sql()} SELECT repo_id, path, pattern, line FROM signals", uses=("files",))
def injection_signals(spark, sf_dir):
    found = textscan.injection_signals(adapt(spark, sf_dir, "files"), SIGNAL_PATTERNS)
    return found.select("repo_id", "path", "pattern", "line")


@query(
    "injection_files",
    f"WITH {_signals_sql()} SELECT repo_id, path, count(*) AS signals, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns FROM signals GROUP BY ALL",
    uses=("files",),
)
def injection_files(spark, sf_dir):
    found = textscan.injection_findings(textscan.injection_signals(adapt(spark, sf_dir, "files"), SIGNAL_PATTERNS))
    return found.withColumn("patterns", F.array_join("patterns", ","))


def _license_sql(column: str) -> str:
    branches = " ".join(
        "WHEN " + " AND ".join(f"contains(head, '{n}')" for n in needles) + f" THEN '{spdx}'"
        for spdx, needles in C.LICENSE_FINGERPRINTS
    )
    return f"(SELECT *, CASE {branches} END AS license_id FROM (SELECT *, lower({column}) AS head FROM files))"


CLASS_SQL = "CASE WHEN {c} IN ('MIT','Apache-2.0','BSD','BSD-3-Clause','BSD-2-Clause','ISC','Unlicense','PSF-2.0') THEN 'permissive' WHEN {c} IN ('MPL-2.0','LGPL-2.1','LGPL-3.0') THEN 'weak_copyleft' WHEN {c} IN ('GPL-2.0','GPL-3.0') THEN 'strong_copyleft' WHEN {c} = 'AGPL-3.0' THEN 'network_copyleft' ELSE 'unknown' END"


@query(
    "license_by_document",
    f"SELECT doc_id, license_id, {CLASS_SQL.format(c='license_id')} AS license_class FROM {_license_sql('text')} WHERE license_id IS NOT NULL",
    uses=("files",),
)
def license_by_document(spark, sf_dir):
    found = licenses.with_license_of_text(adapt(spark, sf_dir, "files")).where(F.col("license_id").isNotNull())
    return found.select("doc_id", "license_id", licenses.license_class(F.col("license_id")).alias("license_class"))


@query(
    "license_conflicts",
    f"""WITH l AS (SELECT repo_id, path, doc_id, license_id FROM {_license_sql('text')} WHERE license_id IS NOT NULL),
    p AS (SELECT repo_id, arg_min(license_id, doc_id) AS project_license FROM l WHERE {CLASS_SQL.format(c='license_id')} = 'permissive' GROUP BY repo_id)
    SELECT repo_id, path, project_license, license_id, CASE {CLASS_SQL.format(c='license_id')} WHEN 'network_copyleft' THEN 'high' WHEN 'strong_copyleft' THEN 'high' WHEN 'weak_copyleft' THEN 'low' END AS severity
    FROM l JOIN p USING (repo_id) WHERE severity IS NOT NULL""",
    uses=("files",),
)
def license_conflicts(spark, sf_dir):
    found = licenses.with_license_of_text(adapt(spark, sf_dir, "files")).where(F.col("license_id").isNotNull())
    project = (
        found.where(licenses.license_class(F.col("license_id")) == "permissive")
        .groupBy("repo_id")
        .agg(F.min_by("license_id", "doc_id").alias("project_license"))
    )
    return (
        found.join(project, "repo_id")
        .withColumn("severity", licenses.conflict_severity(F.col("project_license"), F.col("license_id")))
        .where(F.col("severity").isNotNull())
        .select("repo_id", "path", "project_license", "license_id", "severity")
    )


@query(
    "duplicate_blocks",
    rf"""WITH {LINES_SQL}, n AS (SELECT repo_id, path, line, trim(regexp_replace(line_text, '\s+', ' ', 'g')) AS t FROM lined),
    f AS (SELECT * FROM n WHERE length(t) > 3 AND NOT starts_with(t, '#')),
    w AS (SELECT repo_id, path, line, list(t) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ts FROM f),
    b AS (SELECT repo_id, path, line, array_to_string(ts, chr(10)) AS block FROM w WHERE len(ts) = 6),
    h AS (SELECT repo_id, path, line, sha1(block) AS block_hash FROM b),
    g AS (SELECT repo_id, block_hash, count(*) AS places, count(DISTINCT path) AS files, list((path, line) ORDER BY path, line) AS locs FROM h GROUP BY ALL HAVING count(*) >= 2)
    SELECT repo_id, block_hash, places, files, locs[1][1] AS first_path, locs[1][2] AS first_line FROM g WHERE files > 1 OR locs[2][2] - locs[1][2] >= 6""",
    uses=("files",),
)
def duplicate_blocks(spark, sf_dir):
    # The driver's prose has no brackets to count.
    return textscan.duplicate_blocks(adapt(spark, sf_dir, "files"), min_brackets=0)


@query(
    "line_hash_integrity",
    rf"""WITH {LINES_SQL}, claims AS (SELECT path, 1 + doc_id % 4 AS s, 2 + doc_id % 4 + doc_id % 3 AS e FROM files WHERE doc_id % 10 <> 0),
    joined AS (SELECT c.path, string_agg(line_text, chr(10) ORDER BY line) AS chunk FROM claims c LEFT JOIN lined l ON l.path = c.path AND l.line BETWEEN s AND e GROUP BY ALL)
    SELECT path, sha256(coalesce(chunk, '')) AS content_hash FROM joined UNION ALL SELECT path, sha256(text) FROM files WHERE doc_id % 10 = 0""",
    uses=("files",),
)
def line_hash_integrity(spark, sf_dir):
    doc = F.col("doc_id")
    start = F.when(doc % 10 != 0, (1 + doc % 4).cast("int"))
    end = F.when(doc % 10 != 0, (2 + doc % 4 + doc % 3).cast("int"))
    return adapt(spark, sf_dir, "files").select("path", T.line_range_hash(F.col("text"), start, end).alias("content_hash"))


@query(
    "pattern_search",
    rf"""WITH {LINES_SQL} SELECT repo_id, path, line, trim(line_text) AS excerpt FROM lined WHERE regexp_matches(line_text, '\+1 \(\d+\) 555')""",
    uses=("files",),
)
def pattern_search(spark, sf_dir):
    return textscan.search_lines(adapt(spark, sf_dir, "files"), r"\+1 \(\d+\) 555")


@query(
    "large_files",
    "SELECT repo_id, path, length(text) - length(replace(text, chr(10), '')) AS line_breaks FROM files WHERE line_breaks > 40",
    uses=("files",),
)
def large_files(spark, sf_dir):
    found = textscan.large_sources(adapt(spark, sf_dir, "files"), more_than=40)
    return found.withColumn("line_breaks", F.col("line_breaks").cast("bigint"))


@query(
    "evidence_excerpts",
    rf"""WITH {LINES_SQL}, c AS (SELECT path, left(string_agg(line_text, chr(10) ORDER BY line), 200) AS excerpt FROM lined WHERE line BETWEEN 2 AND 4 GROUP BY path)
    SELECT path, sha256(coalesce(excerpt, '')) AS excerpt_hash FROM files LEFT JOIN c USING (path)""",
    uses=("files",),
)
def evidence_excerpts(spark, sf_dir):
    shown = T.excerpt(F.col("text"), F.lit(2), F.lit(4), 200)
    return adapt(spark, sf_dir, "files").select("path", F.sha2(shown, 256).alias("excerpt_hash"))


@query(
    "path_facts",
    r"""SELECT path, regexp_matches(path, '(^|/)(docs?|examples?|samples?)(/|$)') AS is_fixture, split_part(path, '/', 2) AS component FROM files""",
    uses=("files",),
)
def path_facts(spark, sf_dir):
    facts = S.with_path_facts(adapt(spark, sf_dir, "files"))
    return facts.select("path", "is_fixture", F.get("components", F.lit(0)).alias("component"))


@query(
    "term_sets",
    """WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_.+/-]+')) AS w FROM conversations),
    t AS (SELECT DISTINCT conv_id, turn, regexp_replace(regexp_replace(w, '^\\.+', ''), '\\.+$', '') AS term FROM w WHERE length(w) > 2)
    SELECT conv_id, turn, count(*) AS terms, sha256(string_agg(term, ',' ORDER BY term)) AS term_hash FROM t WHERE term NOT IN ({stop}) GROUP BY ALL""".replace(
        "{stop}", ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)
    ).replace("\\\\", "\\"),
)
def term_sets(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.terms(F.col("text")).alias("t"))
    return found.where(F.size("t") > 0).select(
        "conv_id",
        "turn",
        F.size("t").cast("bigint").alias("terms"),
        F.sha2(F.array_join(F.array_sort("t"), ","), 256).alias("term_hash"),
    )


@query(
    "repository_profile",
    """SELECT repo_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, CAST(0 AS BIGINT) AS source_file_count, any_value(NULL::VARCHAR) AS primary_language FROM files GROUP BY repo_id""",
    uses=("files",),
)
def repository_profile(spark, sf_dir):
    profile = S.repository_profile(adapt(spark, sf_dir, "files"))
    return profile.select("repo_id", "file_count", "total_bytes", "source_file_count", "primary_language")

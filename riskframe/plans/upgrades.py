"""Queries on documented breaking changes, the call sites they break, and the versions projects ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import deps
from riskframe.plans.registry import query
from riskframe.sources.adapters import table
from riskframe.sources.manifests import project_pins, tag_of_version

RULES = {
    "package": "concat('pkg', p_partkey)",
    "id": "concat('r', p_partkey)",
    "call": "CASE WHEN p_size % 8 = 2 THEN concat('*.fn', p_partkey) ELSE concat('pkg', p_partkey, '.fn', p_partkey) END",
    "condition": "CASE p_size % 4 WHEN 0 THEN 'missing_keyword' WHEN 1 THEN 'has_keyword' WHEN 2 THEN 'called' ELSE 'result_method_called' END",
    "keyword": "concat('k', p_partkey % 3)",
    "method": "concat('m', p_partkey % 5)",
    "breaking_in": "concat(p_size % 7, '.', p_partkey % 4, CASE WHEN p_partkey % 9 = 0 THEN 'rc1' ELSE '' END)",
}
UPGRADES = {
    "repo_id": "l_suppkey",
    "package": "concat('pkg', l_partkey)",
    "current_version": "concat(l_linenumber, '.', l_orderkey % 4, CASE WHEN l_orderkey % 7 = 0 THEN 'rc1' ELSE '' END)",
    "target_version": "CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN concat(l_linenumber + 2, '.', l_orderkey % 5) ELSE 'main' END",
}
CALLS = {
    "repo_id": "l_suppkey",
    "path": "concat('app/o', l_orderkey, '.py')",
    "line": "l_linenumber",
    "resolved": "concat(CASE WHEN l_orderkey % 3 = 0 THEN 'other' ELSE concat('pkg', l_partkey) END, '.fn', l_partkey)",
    "receiver": "CASE WHEN l_returnflag = 'A' THEN concat('v', l_linenumber) END",
    "receiver_call": "CASE WHEN l_returnflag = 'R' THEN concat('pkg', l_partkey, '.fn', l_partkey) END",
    "method": "concat('m', l_partkey % 5)",
    "keyword": "CASE WHEN l_orderkey % 4 > 0 THEN concat('k', l_orderkey % 3) END",
}
ASSIGNED = {
    "repo_id": "l_suppkey",
    "path": "concat('app/o', l_orderkey, '.py')",
    "name": "concat('v', l_linenumber)",
    "callee": "CASE WHEN l_linestatus = 'O' THEN concat('pkg', l_partkey, '.fn', l_partkey) ELSE 'other.fn' END",
}


def listed(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def rank(version: str) -> str:
    """SQL of a number that sorts like ``major.minor`` with or without ``rc1``; null for other texts."""
    part = lambda n: f"CAST(nullif(regexp_extract({version}, '^([0-9]+)[.]([0-9]+)', {n}), '') AS BIGINT)"
    return f"{part(1)} * 1000 + {part(2)} * 10 + CASE WHEN {version} LIKE '%rc1' THEN 2 ELSE 3 END"


RULES_SQL = f"""r AS (SELECT {', '.join(listed(RULES))} FROM part),
    u AS (SELECT DISTINCT {', '.join(listed(UPGRADES))} FROM lineitem),
    a AS (SELECT u.*, r.* EXCLUDE (package) FROM u JOIN r USING (package)
      WHERE {rank('current_version')} < {rank('breaking_in')} AND coalesce({rank('target_version')} >= {rank('breaking_in')}, true))"""
BROKEN_SQL = f"""{RULES_SQL}, c AS (SELECT {', '.join(listed(CALLS))} FROM lineitem), s AS (SELECT {', '.join(listed(ASSIGNED))} FROM lineitem),
    n AS (SELECT DISTINCT repo_id, package, id, call, condition, keyword, method FROM a),
    b AS (SELECT c.repo_id, package, id, path, line FROM c JOIN n ON c.repo_id = n.repo_id AND split_part(resolved, '.', 2) = split_part(call, '.', 2)
        WHERE (resolved = call OR call LIKE '*.%') AND CASE condition WHEN 'missing_keyword' THEN c.keyword IS DISTINCT FROM n.keyword WHEN 'has_keyword' THEN c.keyword = n.keyword ELSE condition = 'called' END
      UNION SELECT c.repo_id, package, id, path, line FROM c JOIN n ON c.repo_id = n.repo_id AND c.method = n.method AND receiver_call = call WHERE condition = 'result_method_called'
      UNION SELECT c.repo_id, package, id, c.path, line FROM c JOIN s ON c.repo_id = s.repo_id AND c.path = s.path AND receiver = name
        JOIN n ON c.repo_id = n.repo_id AND c.method = n.method AND callee = call WHERE condition = 'result_method_called')"""


def applicable(spark, sf_dir):
    upgrades = table(spark, sf_dir, "lineitem").selectExpr(*listed(UPGRADES)).distinct()
    return deps.applicable_break_rules(upgrades, table(spark, sf_dir, "part").selectExpr(*listed(RULES)))


def broken(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    calls = items.selectExpr(*listed(CALLS)).withColumn("keywords", F.when(F.col("keyword").isNotNull(), F.array("keyword")))
    return deps.broken_call_sites(applicable(spark, sf_dir), calls.drop("keyword"), items.selectExpr(*listed(ASSIGNED)))


@query("applicable_break_rules", f"WITH {RULES_SQL} SELECT repo_id, package, id, condition, current_version, target_version FROM a")
def applicable_break_rules(spark, sf_dir):
    return applicable(spark, sf_dir).select("repo_id", "package", "id", "condition", "current_version", "target_version")


@query("broken_call_sites", f"WITH {BROKEN_SQL} SELECT repo_id, package, id, path, line FROM b")
def broken_call_sites(spark, sf_dir):
    return broken(spark, sf_dir).select("repo_id", "package", "id", "path", "line")


@query(
    "upgrade_findings",
    f"""WITH {BROKEN_SQL} SELECT repo_id, package, count(*) AS call_sites, count(DISTINCT path) AS files, count(DISTINCT id) AS rules,
      'api.upgrade_breaking_changes' AS rule_id, 'medium' AS severity FROM b GROUP BY repo_id, package""",
)
def upgrade_findings(spark, sf_dir):
    found = deps.upgrade_findings(broken(spark, sf_dir))
    rules = F.size("breaking_rules").cast("bigint").alias("rules")
    return found.select("repo_id", "package", "call_sites", "files", rules, "rule_id", "severity")


ASKED = {
    "repo_id": "l_orderkey % 500",
    "name": "concat('pkg-', l_partkey)",
    "ecosystem": "'PyPI'",
    "manifest": "concat('req', l_linenumber % 3, '.txt')",
    "line": "l_orderkey * 10 + l_linenumber",
    "spec": "CASE l_linenumber % 5 WHEN 0 THEN concat('==1.', l_orderkey % 9) WHEN 1 THEN concat('>=1.', l_orderkey % 9, ',<3') WHEN 2 THEN concat('~= 2.', l_orderkey % 9) WHEN 3 THEN '' ELSE '<3' END",
    "version": "CASE WHEN l_linenumber % 5 = 0 THEN concat('1.', l_orderkey % 9) END",
}


@query(
    "project_pins",
    f"""WITH d AS (SELECT {', '.join(listed(ASKED))} FROM lineitem),
    f AS (SELECT DISTINCT ON (repo_id, name) * FROM d WHERE name IN (SELECT concat('pkg-', p_partkey) FROM part) ORDER BY repo_id, name, manifest, line)
    SELECT repo_id, name, manifest, line, spec, version, coalesce(version, nullif(regexp_extract(spec, '(>=|~=)[ ]*([0-9.]+)', 2), '')) AS floor FROM f""",
)
def pins(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").selectExpr(*listed(ASKED))
    packages = table(spark, sf_dir, "part").selectExpr("concat('PKG_', p_partkey) AS name", "'PyPI' AS ecosystem")
    return project_pins(asked, packages).select("repo_id", "name", "manifest", "line", "spec", "version", "floor")


TAGS = {
    "library": "concat('pkg', l_partkey)",
    "tag": "concat(CASE l_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'v' WHEN 2 THEN 'Release-' WHEN 3 THEN concat('pkg', l_partkey, '-') "
    "WHEN 4 THEN concat('PKG', l_partkey, '@') ELSE 'nightly-' END, l_linenumber, '.', l_suppkey % 4)",
}


@query(
    "tags_of_versions",
    f"""WITH t AS (SELECT DISTINCT {', '.join(listed(TAGS))} FROM lineitem),
    v AS (SELECT DISTINCT concat('pkg', l_partkey) AS library, concat(l_linenumber, '.', l_suppkey % 4) AS version FROM lineitem),
    s AS (SELECT library, version, tag, CASE lower(tag) WHEN version THEN 0 WHEN concat('v', version) THEN 1 WHEN concat(library, '-', version) THEN 2
        WHEN concat(library, '@', version) THEN 3 WHEN concat('release-', version) THEN 5 END AS place FROM v JOIN t USING (library))
    SELECT library, version, arg_min(tag, (place, tag)) AS tag FROM s WHERE place IS NOT NULL GROUP BY library, version""",
)
def tags_of_versions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    versions = items.selectExpr(
        "concat('pkg', l_partkey) AS library", "concat(l_linenumber, '.', l_suppkey % 4) AS version", "concat('pkg', l_partkey) AS package"
    ).distinct()
    return tag_of_version(versions, items.selectExpr(*listed(TAGS)).distinct()).select("library", "version", "tag")

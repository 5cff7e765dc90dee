"""The driver's tables seen as our tables.

Each adapter is one projection, written once as SQL expressions that Spark and other SQL engines read alike, so a check
can repeat it word for word. ``{list}`` stands for the engine's array constructor.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from riskframe import constants as C


def _pick(index: str, values) -> str:
    branches = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} {branches} END)"


_AGENT_OF_CATEGORY = (
    "security_agent",
    "dependency_agent",
    "code_quality_agent",
    "api_compatibility_agent",
    "test_reliability_agent",
    "license_agent",
    "performance_agent",
    "maintenance_agent",
)
_RULES = {
    0: ("security.sql_injection", "security.jwt_no_algorithms", "security.hardcoded_secret"),
    1: ("dependency.vulnerable", "dependency.outdated", "dependency.unpinned"),
    2: ("code_quality.high_complexity", "code_quality.data_access_assessment", "code_quality.silent_exception"),
    3: ("api.upgrade_breaking_changes", "api.breaking_change", "api.deprecated_api_in_use"),
    4: ("testing.untested_critical_path", "testing.weak_assertion", "testing.test_failure"),
    5: ("license.metadata_mismatch", "license.copyleft_file", "license.missing"),
    6: ("performance.n_plus_one", "performance.network_in_loop", "performance.regex_compile_in_loop"),
    7: ("maintenance.inactive", "maintenance.bus_factor", "maintenance.stale_module"),
}
_COMPONENTS = ("authentication", "authorization", "cryptography", "payments", "api", "data-access")

_RULE = "(CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {_pick('o_orderkey % 3', v)}" for k, v in _RULES.items()) + " END)"
_COMPONENT = _pick("o_custkey % 6", _COMPONENTS)
_FILE = (
    f"(CASE WHEN o_orderkey % 8 = 4 AND o_orderkey % 3 = 1 THEN concat('tests/test_mod_', o_custkey, '.py') "
    f"ELSE concat('src/', {_COMPONENT}, '/mod_', o_custkey, '.py') END)"
)
_PACKAGE = "(CASE WHEN o_orderkey % 8 IN (0, 1, 3, 4, 6) AND o_orderkey % 5 <> 4 THEN concat('pkg', o_custkey % 1000) END)"

ADAPTERS: dict[str, tuple[str, dict[str, str]]] = {
    "findings": (
        "orders",
        {
            "finding_id": "o_orderkey",
            "repo_id": "o_custkey % 50",
            "agent": _pick("(o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 8", _AGENT_OF_CATEGORY),
            "category": _pick("o_orderkey % 8", C.CATEGORIES),
            "rule_id": _RULE,
            "title": f"concat({_RULE}, ' in ', {_FILE})",
            "severity": "(CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' "
            "WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END)",
            "status": "(CASE WHEN o_orderkey % 11 = 0 THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'verified' "
            "WHEN o_orderstatus = 'O' THEN 'proposed' ELSE 'needs_more_evidence' END)",
            "subject": f"concat('py:', {_FILE}, '::fn_', o_orderkey % 4)",
            "file": _FILE,
            "component": _COMPONENT,
            "affected_files": f"(CASE WHEN o_orderkey % 5 = 0 THEN {{list}}({_FILE}, concat('src/', {_COMPONENT}, '/mod_', "
            f"o_custkey + 300, '.py')) ELSE {{list}}({_FILE}) END)",
            "affected_components": f"(CASE WHEN o_orderkey % 7 = 0 THEN {{list}}({_COMPONENT}, 'secrets') ELSE {{list}}({_COMPONENT}) END)",
            "lines": "{list}(o_orderkey % 4 + 1)",
            "stance": "(CASE WHEN o_orderkey % 8 = 2 THEN (CASE WHEN o_orderkey % 5 < 3 THEN 'acceptable' ELSE 'concern' END) END)",
            "measurement": f"(CASE WHEN o_orderkey % 8 = 6 THEN {_pick('o_orderkey % 3', ('measured', 'static_suspect', 'measured_no_issue'))} END)",
            "package": _PACKAGE,
            "packages": "(CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 3 = 2 THEN "
            "{list}(concat('pkg', o_custkey % 1000), concat('pkg', (o_custkey + 50) % 1000)) END)",
            "version": "concat(o_orderkey % 3, '.', o_orderkey % 10, '.', o_orderkey % 7)",
            "vulnerable": "(o_orderkey % 8 = 1 AND o_orderkey % 3 = 0)",
            "advisory_max_severity": "(CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 3 = 0 THEN "
            f"{_pick('o_orderkey % 5', ('critical', 'high', 'medium', 'low', 'unknown'))} END)",
            "reachability": f"(CASE WHEN o_orderkey % 8 IN (0, 1) THEN {_pick('o_custkey % 4', ('entrypoint', 'reachable', 'unreachable'))} END)",
            "impact": "(CASE WHEN o_orderkey % 97 = 0 THEN 0.9e0 END)",
            "likelihood": "(CASE WHEN o_orderkey % 89 = 0 THEN 0.7e0 END)",
            "test_only": "(o_orderkey % 8 = 4 AND o_orderkey % 3 = 1)",
            "is_hypothesis": "(o_orderkey % 23 = 0)",
            "reproduced": "(o_orderkey % 8 = 6 AND o_orderkey % 3 = 0)",
            "static_suspect": "(o_orderkey % 8 = 6 AND o_orderkey % 3 = 1)",
            "corroborating_agents": "o_orderkey % 5",
            "contradictions": "(CASE WHEN o_orderkey % 7 = 0 THEN 1 + o_orderkey % 3 ELSE 0 END)",
            "complexity": "o_orderkey % 40",
            "created_at": "o_orderdate",
        },
    ),
    "evidence": (
        "lineitem",
        {
            "finding_id": "l_orderkey",
            "evidence_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
            "source_type": _pick("(l_partkey + l_linenumber) % 7", C.SOURCE_TYPES),
            "confidence": "0.5e0 + 5 * l_discount",
            "line_start": "l_linenumber",
            "package": "concat('pkg', l_partkey % 200)",
            "advisory_severity": f"(CASE WHEN l_partkey % 3 = 0 THEN {_pick('l_partkey % 5', ('critical', 'high', 'medium', 'low', 'unknown'))} END)",
            "created_at": "l_shipdate",
        },
    ),
    "commits": (
        "events",
        {
            "repo_id": "user_id % 15",
            "sha": "event_id",
            "author": "user_id",
            "date": "ts",
            "top_dir": "event_type",
        },
    ),
    "runs": (
        "events",
        {
            "repo_id": "user_id % 15",
            "run_id": "event_id",
            "agent": _pick("event_id % 12", C.SPECIALISTS + C.COORDINATORS),
            "mode": "event_type",
            "attempt": "1 + event_id % 3",
            "trigger": _pick("event_id % 5", ("initial_plan", "initial_plan", "retry", "follow_up", "verification_request")),
            "strategy": "(CASE WHEN event_id % 31 = 0 THEN 'static_only' ELSE 'default' END)",
            "status": "(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END)",
            "started_at": "ts",
            "duration_s": "CAST(floor(value * 60) AS BIGINT)",
            "findings_count": "event_id % 4",
            "tool_calls": "event_id % 9",
        },
    ),
    "trace": (
        "events",
        {
            "repo_id": "user_id",
            "event_id": "event_id",
            "event_type": "event_type",
            "sender": _pick("event_id % 8", C.SPECIALISTS),
            "receiver": _pick("event_id % 4", C.COORDINATORS),
            "message": "props",
            "ts": "ts",
        },
    ),
    "deps": (
        "lineitem",
        {
            "repo_id": "l_suppkey % 50",
            "name": "concat('pkg', l_partkey % 200)",
            "ecosystem": "'PyPI'",
            "spec": "concat('>=', l_tax)",
            "manifest": "concat(l_returnflag, l_linestatus, '/requirements.txt')",
            "line": "l_linenumber",
            "pinned": "(l_linenumber % 2 = 1)",
            "version": "(CASE WHEN l_linenumber % 2 = 1 THEN concat(l_partkey % 3, '.', l_partkey % 10, '.', l_partkey % 7) END)",
            "dev": "(l_linenumber % 5 = 0)",
            "resolved_from": "(CASE WHEN l_linenumber % 6 = 2 THEN 'package-lock.json' END)",
            "row_key": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
        },
    ),
    "files": (
        "documents",
        {
            "repo_id": "source",
            "path": "concat('src/', lang, '/doc_', doc_id, '.md')",
            "doc_id": "doc_id",
            "text": "text",
        },
    ),
    "watches": (
        "customer",
        {
            "watch_id": "c_custkey",
            "project_id": "c_nationkey",
            "enabled": "(c_acctbal > 0)",
            "frequency": _pick("c_custkey % 4", ("hourly", "daily", "weekly", "manual")),
            "status": _pick("c_custkey % 7", ("ok", "failed", "checking", "ok", "pending", "ok", "ok")),
            "next_check_hours": "(CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 97 AS BIGINT) - 48 END)",
            "last_seen_sha": "(CASE WHEN c_custkey % 6 <> 0 THEN concat('sha', c_custkey % 5) END)",
            "head_sha": "concat('sha', c_custkey % 4)",
            "has_snapshot": "(c_custkey % 9 <> 0)",
            "pin_version": "(CASE WHEN c_custkey % 8 < 5 THEN concat(c_custkey % 3, '.', c_custkey % 10) END)",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zone-less instants are UTC (``spark.sql.session.timeZone``)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    zoneless = {f.name: df[f.name].cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of our tables, projected from the driver's."""
    source, columns = ADAPTERS[name]
    return table(spark, sf_dir, source).selectExpr(
        *[f"{expr.replace('{list}', 'array')} AS `{alias}`" for alias, expr in columns.items()]
    )


def adapter_sql(name: str) -> str:
    """The same projection as a subquery for a check in another SQL engine."""
    source, columns = ADAPTERS[name]
    body = ", ".join(f"{expr.replace('{list}', 'list_value')} AS {alias}" for alias, expr in columns.items())
    return f"{name} AS (SELECT {body} FROM {source})"

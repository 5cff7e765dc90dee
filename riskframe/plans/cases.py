"""Queries on verification, recommendations, notifications, questions and planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.functions.lookup import literal_table
from riskframe.operators import ask, correlate, notify, orchestrate, recommend, reports, risk, sequence, verify
from riskframe.plans.activity import runs as all_runs
from riskframe.plans.findings import (
    CONFIDENCE_SQL,
    MEMBERS_SQL,
    RISK_SQL,
    RULING_SQL,
    SCORE_SQL,
    correlated,
    ruled_correlations,
    scored_findings,
)
from riskframe.plans.registry import query
from riskframe.session import stage
from riskframe.sources.adapters import adapt, table

# ------------------------------------------------------------------------------------- verification
LABELS_SQL = """checks AS (SELECT l.doc_id, d.source, 'quality' AS chk, CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'fail' ELSE 'inconclusive' END AS outcome,
      CASE WHEN quality = 0 AND toxic = 1 THEN 'rejection' WHEN quality = 0 THEN 'more_evidence' END AS supports FROM labels l JOIN documents d USING (doc_id)
      UNION ALL SELECT l.doc_id, d.source, 'toxicity', CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END, CASE WHEN toxic = 1 THEN 'rejection' END FROM labels l JOIN documents d USING (doc_id)
      UNION ALL SELECT l.doc_id, d.source, 'size', CASE WHEN n_chars < 400 THEN 'fail' ELSE 'not_applicable' END, CASE WHEN n_chars < 400 THEN 'downgrade' END FROM labels l JOIN documents d USING (doc_id))"""


@query(
    "verification_policy",
    f"""WITH {LABELS_SQL}, c AS (SELECT source, doc_id, count(*) FILTER (outcome = 'fail' AND supports = 'rejection') AS rejecting, count(*) FILTER (outcome IN ('fail', 'inconclusive') AND supports = 'more_evidence') AS wanting,
      count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome <> 'not_applicable') AS applicable FROM checks GROUP BY ALL),
    d AS (SELECT *, CASE WHEN rejecting > 0 THEN 'rejected' WHEN wanting > 0 THEN 'needs_more_evidence' ELSE 'verified' END AS decision FROM c)
    SELECT source, doc_id, decision, round(0.5e0 + 0.5e0 * (CASE WHEN decision = 'rejected' THEN failed ELSE passed END) / greatest(applicable, 1) + 1e-10, 3) AS verdict_confidence FROM d""",
)
def verification_policy(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    good, toxic, short = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") < 400
    rows = F.array(
        F.struct(
            F.lit("quality").alias("check"),
            F.when(good, "pass").when(toxic, "fail").otherwise("inconclusive").alias("outcome"),
            F.when(~good & toxic, "rejection").when(~good, "more_evidence").alias("supports"),
        ),
        F.struct(
            F.lit("toxicity").alias("check"),
            F.when(toxic, "fail").otherwise("pass").alias("outcome"),
            F.when(toxic, "rejection").alias("supports"),
        ),
        F.struct(
            F.lit("size").alias("check"),
            F.when(short, "fail").otherwise("not_applicable").alias("outcome"),
            F.when(short, "downgrade").alias("supports"),
        ),
    )
    checks = joined.select("source", "doc_id", F.inline(rows))
    decided = verify.decide(verify.count_checks(checks, ("source", "doc_id")))
    return decided.select("source", "doc_id", "decision", "verdict_confidence")


TEST_OR_FIXTURE = r"(^|/)(tests?|__tests__|spec|specs|testing|fixtures?|testdata|test_data|mocks?|examples?|samples?|docs?)(/|$)"
VERIFY_SQL = (
    MEMBERS_SQL
    + f""", ev AS (SELECT finding_id, count(*) FILTER (source_type IN ('benchmark', 'test')) AS measured_items, count(*) FILTER (source_type = 'test') AS test_items,
        arg_max(advisory_severity, (CASE advisory_severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END, advisory_severity)) AS ev_sev FROM evidence GROUP BY finding_id),
    sides AS (SELECT c.repo_id, c.signature, m.f AS finding_id, CASE WHEN m.f = c.issue THEN c.ok ELSE c.issue END AS other FROM c1_pairs c, LATERAL (SELECT unnest([c.issue, c.ok]) AS f) m),
    contested AS (SELECT s.finding_id, bool_or(coalesce(o.measurement = 'measured', false)) AS other_measured FROM sides s JOIN scored o ON o.finding_id = s.other GROUP BY s.finding_id),
    facts AS (SELECT f.*, coalesce(ev.measured_items, 0) > 0 OR coalesce(measurement = 'measured', false) AS own_measured, coalesce(test_items, 0) AS test_items, ev_sev, c.finding_id IS NOT NULL AS is_contested, coalesce(other_measured, false) AS other_measured,
        f.reachability AS reach FROM scored f LEFT JOIN ev USING (finding_id) LEFT JOIN contested c ON c.finding_id = f.finding_id),
    outside AS (SELECT finding_id, len(list_filter(affected_files, lambda x: NOT regexp_matches(x, '{TEST_OR_FIXTURE}') AND NOT regexp_matches(x, {{test_path}}))) = 0 AS is_outside FROM facts),
    c AS (
      SELECT finding_id, 'staleness' AS chk, 'pass' AS outcome, NULL AS supports FROM facts
      UNION ALL SELECT finding_id, 'evidence_integrity', 'not_applicable', NULL FROM facts
      UNION ALL SELECT f.finding_id, 'location_context', CASE WHEN is_outside THEN 'fail' ELSE 'pass' END, CASE WHEN is_outside THEN 'downgrade' END FROM facts f JOIN outside o USING (finding_id)
        WHERE category IN ('security', 'api_compatibility') OR rule_id = 'license.copyleft_file'
      UNION ALL SELECT finding_id, 'placeholder', 'inconclusive', 'more_evidence' FROM facts WHERE rule_id = 'security.hardcoded_secret'
      UNION ALL SELECT finding_id, 'production_reference', 'fail', 'rejection' FROM facts WHERE rule_id = 'security.hardcoded_secret'
      UNION ALL SELECT finding_id, 'dependency_used', 'fail', 'downgrade' FROM facts WHERE category = 'dependency' AND package IS NOT NULL
      UNION ALL SELECT finding_id, 'severity_justified', CASE WHEN bad THEN 'fail' ELSE 'pass' END, CASE WHEN bad THEN 'downgrade' END FROM (SELECT *, coalesce((CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)
          > (CASE coalesce(ev_sev, advisory_max_severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 WHEN 'info' THEN 0 ELSE 2 END), false) AS bad FROM facts) WHERE category = 'dependency' AND package IS NOT NULL AND vulnerable
      UNION ALL SELECT finding_id, 'reachability', CASE WHEN reach IN ('entrypoint', 'reachable') THEN 'pass' ELSE 'inconclusive' END, NULL FROM facts
        WHERE (category IN ('security', 'api_compatibility') AND rule_id <> 'security.hardcoded_secret') OR category = 'performance' OR rule_id = 'license.copyleft_file'
      UNION ALL SELECT finding_id, 'mitigation', 'inconclusive', 'downgrade' FROM facts WHERE rule_id = 'security.jwt_no_algorithms'
      UNION ALL SELECT finding_id, 'measured', CASE WHEN measurement = 'measured' THEN 'pass' WHEN measurement = 'measured_no_issue' THEN 'fail' WHEN severity IN ('low', 'info') THEN 'pass' ELSE 'inconclusive' END,
          CASE WHEN measurement = 'measured' THEN NULL WHEN measurement = 'measured_no_issue' THEN 'rejection' WHEN severity IN ('low', 'info') THEN NULL ELSE 'more_evidence' END FROM facts WHERE category = 'performance'
      UNION ALL SELECT finding_id, 'testing', CASE rule_id WHEN 'testing.test_failure' THEN 'inconclusive' WHEN 'testing.untested_critical_path' THEN 'fail' ELSE 'pass' END, CASE WHEN rule_id = 'testing.untested_critical_path' THEN 'rejection' END FROM facts WHERE category = 'testing'
      UNION ALL SELECT finding_id, 'coverage_measurement', 'pass', NULL FROM facts WHERE rule_id = 'testing.untested_critical_path' AND test_items > 0
      UNION ALL SELECT finding_id, 'recompute', CASE WHEN complexity % 3 = 0 THEN 'fail' ELSE 'pass' END, CASE WHEN complexity % 3 = 0 THEN 'rejection' END FROM facts WHERE rule_id = 'code_quality.high_complexity'
      UNION ALL SELECT finding_id, 'false_positive', 'pass', NULL FROM facts WHERE rule_id = 'license.metadata_mismatch'
      UNION ALL SELECT finding_id, 'source_quality', 'pass', NULL FROM facts WHERE category = 'maintenance' OR (category = 'dependency' AND package IS NULL)
      UNION ALL SELECT finding_id, 'contradiction', CASE WHEN coalesce(stance = 'acceptable', false) AND other_measured THEN 'fail' WHEN NOT coalesce(stance = 'acceptable', false) AND own_measured THEN 'pass' ELSE 'inconclusive' END,
          CASE WHEN coalesce(stance = 'acceptable', false) AND other_measured THEN 'rejection' WHEN NOT coalesce(stance = 'acceptable', false) AND own_measured THEN NULL ELSE 'more_evidence' END FROM facts WHERE is_contested),
    counted AS (SELECT finding_id, count(*) FILTER (outcome = 'fail' AND supports = 'rejection') AS rejecting, count(*) FILTER (supports = 'more_evidence') AS wanting, count(*) FILTER (outcome = 'fail' AND supports = 'downgrade') AS downgrading,
        count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome <> 'not_applicable') AS applicable FROM c GROUP BY finding_id),
    verdicts AS (SELECT *, CASE WHEN rejecting > 0 THEN 'rejected' WHEN wanting > 0 THEN 'needs_more_evidence' ELSE 'verified' END AS decision FROM counted)"""
).replace(
    "{test_path}",
    r"'(^|/)(tests?|__tests__|spec|specs|testing)(/|$)|(^|/)(test_[^/]+\.py|[^/]+_test\.(py|go)|[^/]+\.(test|spec)\.[jt]sx?)$'",
)


def decided_findings(spark, sf_dir):
    """All findings with their facts, checks and decisions."""
    findings = stage(scored_findings(spark, sf_dir).drop("confidence_factors"))
    evidence = adapt(spark, sf_dir, "evidence")
    contested = correlate.contradictions(correlate.open_findings(findings))
    measured = verify.measured_facts(evidence).select("finding_id", "_measured_items", "test_evidence")
    facts = (
        findings.join(verify.advisory_facts(evidence), "finding_id", "left")
        .join(measured, "finding_id", "left")
        .join(verify.contradiction_facts(contested, findings), ["repo_id", "finding_id"], "left")
        .withColumns(
            {
                "reach": F.col("reachability"),
                "own_measured": F.coalesce(F.col("measurement") == "measured", F.lit(False))
                | (F.coalesce("_measured_items", F.lit(0)) > 0),
                "recomputed_complexity": F.when(F.col("complexity") % 3 != 0, F.col("complexity")),
            }
        )
    )
    return findings, verify.decide(verify.count_own_checks(verify.with_checks(facts)))


@query(
    "verification_decisions",
    f"""WITH {VERIFY_SQL} SELECT f.repo_id, f.finding_id, v.decision, round(0.5e0 + 0.5e0 * (CASE WHEN decision = 'rejected' THEN failed ELSE passed END) / greatest(applicable, 1) + 1e-10, 3) AS verdict_confidence,
      CASE WHEN decision = 'verified' AND downgrading > 0 THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END END AS adjusted_severity
    FROM facts f JOIN verdicts v USING (finding_id)""",
    uses=("findings", "evidence"),
)
def verification_decisions(spark, sf_dir):
    _findings, decided = decided_findings(spark, sf_dir)
    return decided.select("repo_id", "finding_id", "decision", "verdict_confidence", "adjusted_severity")


@query(
    "decision_counts",
    f"WITH {VERIFY_SQL} SELECT repo_id, decision, count(*) AS n FROM facts JOIN verdicts USING (finding_id) GROUP BY ALL",
    uses=("findings", "evidence"),
)
def decision_counts(spark, sf_dir):
    _findings, decided = decided_findings(spark, sf_dir)
    return decided.groupBy("repo_id", "decision").agg(F.count("*").alias("n"))


@query(
    "counter_evidence",
    f"WITH {VERIFY_SQL} SELECT finding_id, count(*) AS n FROM c WHERE outcome = 'fail' AND supports IN ('rejection', 'downgrade') GROUP BY finding_id",
    uses=("findings", "evidence"),
)
def counter_evidence(spark, sf_dir):
    _findings, decided = decided_findings(spark, sf_dir)
    return verify.counter_evidence(decided).groupBy("finding_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------- recommendations
@query(
    "recommendations",
    "WITH "
    + RISK_SQL
    + RULING_SQL[len(CONFIDENCE_SQL) :]
    + """, worst AS (SELECT l.repo_id, l.signature, max(f.weight) AS w, max(impact_value) AS i, max(exploitability_value) AS e FROM links l JOIN factors f ON f.finding_id = l.finding_id WHERE f.status = 'verified' GROUP BY ALL HAVING count(*) >= 2),
    comp AS (SELECT r.repo_id, r.signature, """
    + SCORE_SQL.format(w="w", c="r.confidence", i="i", e="e", m="round(r.mult + 1e-10, 2)")
    + """ AS score FROM ruled r JOIN worst w ON w.repo_id = r.repo_id AND w.signature = r.signature WHERE kind IN ('compound_risk', 'causal') AND ruling = 'verified'),
    covered AS (SELECT DISTINCT l.finding_id FROM links l JOIN comp c ON c.repo_id = l.repo_id AND c.signature = l.signature JOIN scored s ON s.finding_id = l.finding_id WHERE score >= 12 AND s.status = 'verified')
    SELECT repo_id, 'compound' AS kind, signature AS risk_key, score FROM comp WHERE score >= 12
    UNION ALL SELECT repo_id, 'finding', CAST(finding_id AS VARCHAR), score FROM risks WHERE score >= 12 AND finding_id NOT IN (SELECT finding_id FROM covered)""",
    uses=("findings", "evidence"),
)
def recommendations(spark, sf_dir):
    findings, members = correlated(spark, sf_dir)
    ruled = stage(ruled_correlations(members))
    compounds = risk.compound_risks(findings, ruled, members)
    rows = recommend.recommendations(risk.finding_risks(findings), compounds, members, findings)
    return rows.select("repo_id", "kind", "risk_key", "score")


@query(
    "action_proposals",
    f"""WITH {RISK_SQL} SELECT repo_id, CAST(finding_id AS VARCHAR) AS risk_key, score AS risk_score FROM risks WHERE score >= 60""",
    uses=("findings", "evidence"),
)
def action_proposals(spark, sf_dir):
    risks = risk.finding_risks(scored_findings(spark, sf_dir))
    nothing = risks.select("repo_id", "finding_id").where(F.lit(False))
    rows = recommend.finding_recommendations(risks, nothing, recommend.template_table(spark))
    return recommend.action_proposals(rows).select("repo_id", "risk_key", "risk_score")


# ------------------------------------------------------------------------------------ notifications
CHANNELS = [(0, "mail", "email", True, True), (0, "chat", "slack", True, True), (0, "hook", "webhook", True, False), (0, "old", "slack", False, True)]
RULES = [
    (0, "r1", "click", ["mail", "chat"], {}, True),
    (0, "r2", "error", ["chat", "hook", "old"], {"min_priority": "P2"}, True),
    (0, "r3", "error", ["mail", "chat"], {"min_impact": "high"}, True),
    (0, "r4", "purchase", ["mail"], {"project_id": "3"}, True),
    (0, "r5", "signup", ["chat"], {}, False),
    (0, "r6", "view", ["hook", "gone"], {"watch_id": "1"}, True),
]
RULES_SQL = """channels AS (SELECT * FROM (VALUES ('mail', true, true), ('chat', true, true), ('hook', true, false), ('old', false, true)) t(channel_id, ch_enabled, verified)),
    rules AS (SELECT * FROM (VALUES ('r1', 'click', 'mail'), ('r1', 'click', 'chat'), ('r2', 'error', 'chat'), ('r2', 'error', 'hook'), ('r2', 'error', 'old'), ('r3', 'error', 'mail'), ('r3', 'error', 'chat'), ('r4', 'purchase', 'mail'), ('r6', 'view', 'hook'), ('r6', 'view', 'gone')) t(rule_id, event, channel_id)),
    ev AS (SELECT event_id, event_type AS event, CASE event_id % 6 WHEN 5 THEN NULL ELSE 'P' || (event_id % 6) END AS top_priority, CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'breaking' END AS impact_level,
      CAST(user_id % 5 AS VARCHAR) AS project_id, CAST(user_id % 3 AS VARCHAR) AS watch_id FROM events)"""


def notification_tables(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "CAST(0 AS INT) AS user_id",
        "event_id",
        "event_type AS event",
        "CASE event_id % 6 WHEN 5 THEN NULL ELSE concat('P', event_id % 6) END AS top_priority",
        "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'breaking' END AS impact_level",
        "CAST(user_id % 5 AS STRING) AS project_id",
        "CAST(user_id % 3 AS STRING) AS watch_id",
    )
    channels = literal_table(spark, CHANNELS, "user_id int, channel_id string, kind string, enabled boolean, verified boolean")
    rules = literal_table(
        spark, RULES, "user_id int, rule_id string, event string, channel_ids array<string>, filters map<string,string>, enabled boolean"
    )
    return events, rules, channels


@query(
    "notification_dispatch",
    f"""WITH {RULES_SQL}, m AS (SELECT e.event_id, r.channel_id, r.rule_id, ch_enabled, verified FROM ev e JOIN rules r ON r.event = e.event JOIN channels c ON c.channel_id = r.channel_id
      WHERE CASE rule_id WHEN 'r2' THEN coalesce(top_priority <= 'P2', false) WHEN 'r3' THEN impact_level IN ('high', 'breaking') WHEN 'r4' THEN project_id = '3' WHEN 'r6' THEN watch_id = '1' ELSE true END)
    SELECT event_id, channel_id, min(rule_id) AS rule_id, CASE WHEN any_value(ch_enabled) AND any_value(verified) THEN 'send' ELSE 'skipped' END AS status FROM m GROUP BY ALL""",
)
def notification_dispatch(spark, sf_dir):
    events, rules, channels = notification_tables(spark, sf_dir)
    return notify.dispatch(events, rules, channels).select("event_id", "channel_id", "rule_id", "status")


@query(
    "case_notifications",
    f"""WITH {RISK_SQL}, cases AS (SELECT repo_id, CASE WHEN count(*) % 4 = 0 THEN 'failed' ELSE 'completed' END AS status FROM findings GROUP BY repo_id),
    top AS (SELECT repo_id, CASE WHEN max(score) >= 80 THEN 'P0' WHEN max(score) >= 60 THEN 'P1' WHEN max(score) >= 35 THEN 'P2' WHEN max(score) >= 12 THEN 'P3' ELSE 'P4' END AS top_priority FROM risks GROUP BY repo_id)
    SELECT repo_id, top_priority, CASE WHEN status = 'failed' THEN 'investigation.failed' ELSE unnest(['investigation.completed', 'investigation.risk']) END AS event FROM cases LEFT JOIN top USING (repo_id) WHERE status <> 'failed'
    UNION ALL SELECT repo_id, top_priority, 'investigation.failed' FROM cases LEFT JOIN top USING (repo_id) WHERE status = 'failed'""",
    uses=("findings", "evidence"),
)
def case_notifications(spark, sf_dir):
    findings = scored_findings(spark, sf_dir)
    status = F.when(F.count("*") % 4 == 0, "failed").otherwise("completed")
    cases = findings.groupBy("repo_id").agg(status.alias("status")).withColumn("user_id", F.lit(0))
    return notify.case_notifications(cases, risk.finding_risks(findings)).select("repo_id", "top_priority", "event")


@query(
    "delivery_log",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10",
)
def delivery_log(spark, sf_dir):
    deliveries = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("delivery_id"))
    return reports.delivery_log(deliveries, 10).select("user_id", F.col("delivery_id").alias("event_id"))


# ---------------------------------------------------------------------------------------- questions
# The driver's conversations are invented prose: our own keywords, in the same form as the default table.
TOPICS = {
    "security_agent": ("the", "der", "erla",),
    "dependency_agent": ("que", "con", "del",),
    "license_agent": ("ion", "und", "est",),
    "performance_agent": ("ent", "sch",),
}


def _hits(keywords: str) -> str:
    return " + ".join(f"CAST(contains(q, '{k}') AS INT)" for k in keywords)


@query(
    "question_routing",
    "WITH s AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'), h AS ("
    + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{name}' AS topic, {i} AS pos, {_hits(words)} AS hits FROM s" for i, (name, words) in enumerate(TOPICS.items())
    )
    + """), b AS (SELECT conv_id, turn, arg_min(topic, (-hits, pos)) AS topic, max(hits) AS hits FROM h WHERE hits > 0 GROUP BY ALL)
    SELECT s.conv_id, s.turn, coalesce(topic, 'orchestrator') AS topic, coalesce(hits, 0) AS hits FROM s LEFT JOIN b ON b.conv_id = s.conv_id AND b.turn = s.turn""",
)
def question_routing(spark, sf_dir):
    questions = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.struct("conv_id", "turn").alias("question_id"), F.lit(0).alias("repo_id"), "text"
    )
    routed = ask.route_questions(questions, TOPICS)
    return routed.select("question_id.conv_id", "question_id.turn", "topic", "hits")


@query(
    "finding_relevance",
    f"""WITH {CONFIDENCE_SQL}, q AS (SELECT repo_id, min(finding_id) AS question_id FROM scored GROUP BY repo_id),
    qt AS (SELECT q.repo_id, question_id, unnest(['security.sql_injection', 'sql_injection', 'src/payments/mod_' || (question_id % 100) || '.py', 'performance', 'rejected', 'license']) AS t FROM q),
    ft AS (SELECT DISTINCT repo_id, finding_id, regexp_replace(regexp_replace(w, '^\\.+', ''), '\\.+$', '') AS t FROM (SELECT repo_id, finding_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, '', subject, array_to_string(affected_files, ' '), replace(replace(rule_id, '.', ' '), '_', ' '))), '[a-z0-9_.+/-]+')) AS w FROM scored) WHERE length(w) > 2),
    ov AS (SELECT question_id, finding_id, count(DISTINCT t) AS overlap FROM ft JOIN (SELECT DISTINCT * FROM qt) USING (repo_id, t) GROUP BY ALL),
    r AS (SELECT q.question_id, s.finding_id, coalesce(overlap, 0) - CASE WHEN status = 'rejected' THEN 2 ELSE 0 END AS score, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sev, confidence
      FROM q JOIN scored s ON s.repo_id = q.repo_id LEFT JOIN ov ON ov.question_id = q.question_id AND ov.finding_id = s.finding_id)
    SELECT question_id, finding_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, sev DESC, confidence DESC, finding_id) AS position FROM r) WHERE position <= 8""".replace(
        "\\\\", "\\"
    ),
    uses=("findings", "evidence"),
)
def finding_relevance(spark, sf_dir):
    findings = scored_findings(spark, sf_dir)
    path = F.concat(F.lit("src/payments/mod_"), (F.col("question_id") % 100).cast("string"), F.lit(".py"))
    questions = (
        findings.groupBy("repo_id")
        .agg(F.min("finding_id").alias("question_id"))
        .withColumn("text", F.concat_ws(" ", F.lit("Security.SQL_injection sql_injection"), path, F.lit("performance of the rejected license")))
    )
    return ask.rank_findings(questions, findings).select("question_id", "finding_id", "score", "position")


# ----------------------------------------------------------------------------------------- planning
@query(
    "agent_plan",
    """WITH p AS (SELECT c_custkey AS repo_id, c_custkey % 5 AS src, c_custkey % 3 AS eco, c_custkey % 4 AS pk, c_custkey % 6 AS gc, c_custkey % 7 = 0 AS db, CASE c_custkey % 8 WHEN 0 THEN 'quick' WHEN 1 THEN 'deep' ELSE 'standard' END AS depth FROM customer)
    SELECT repo_id, string_agg(agent, ',' ORDER BY agent) AS selected FROM (
      SELECT repo_id, depth, unnest(['security_agent', 'dependency_agent', 'test_reliability_agent', 'code_quality_agent', 'api_compatibility_agent', 'license_agent', 'maintenance_agent', 'performance_agent']) AS agent,
        unnest([src > 0, eco > 0, src > 0, src > 0, pk > 0 OR eco = 2 OR depth = 'deep', true, gc > 0, db OR depth = 'deep']) AS ok FROM p)
    WHERE ok AND (depth <> 'quick' OR agent IN ('security_agent', 'dependency_agent', 'test_reliability_agent')) GROUP BY repo_id""",
)
def agent_plan(spark, sf_dir):
    key = F.col("c_custkey")
    profiles = table(spark, sf_dir, "customer").select(
        key.alias("repo_id"),
        (key % 5).alias("source_file_count"),
        F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 3 == 2, F.array(F.lit("npm"))).otherwise(F.array(F.lit("PyPI"))).alias("ecosystems"),
        F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("pkg"))).alias("python_packages"),
        (key % 6).alias("git_commits"),
        (key % 7 == 0).alias("uses_database"),
        F.lit(False).alias("uses_network_calls"),
        F.when(key % 8 == 0, "quick").when(key % 8 == 1, "deep").otherwise("standard").alias("depth"),
    )
    planned = orchestrate.plan(profiles).where("selected")
    # Eight specialists exist, so a repository's list has at most eight names.
    return planned.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("agent")), ",").alias("selected"))


@query(
    "request_decisions",
    """WITH r AS (SELECT l_suppkey % 50 AS repo_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id, l_partkey % 5 AS e, 'pkg' || (l_partkey % 20) AS package, CASE WHEN l_linenumber % 2 = 0 THEN '2.0' END AS target FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)),
    t AS (SELECT repo_id, request_id, agent, mode, package || '|1.0' || coalesce('|' || target, '') AS focus FROM (
      SELECT *, 'security_agent' AS agent, 'dependency_usage' AS mode FROM r WHERE e IN (0, 2) UNION ALL SELECT *, 'api_compatibility_agent', 'upgrade_compatibility' FROM r WHERE (e = 0 AND target IS NOT NULL)
      UNION ALL SELECT *, 'test_reliability_agent', 'dependency_coverage' FROM r WHERE e IN (0, 3) UNION ALL SELECT *, 'performance_agent', 'benchmark' FROM r WHERE e = 1) WHERE NOT (agent = 'performance_agent' AND repo_id % 2 = 0)),
    done AS (SELECT DISTINCT repo_id, agent, mode, focus FROM t WHERE starts_with(focus, 'pkg1')),
    f AS (SELECT t.repo_id, t.request_id, count(*) AS planned, count(*) FILTER (d.agent IS NULL) AS fresh FROM t LEFT JOIN done d ON d.repo_id = t.repo_id AND d.agent = t.agent AND d.mode = t.mode AND d.focus = t.focus GROUP BY ALL)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN f.request_id IS NULL THEN 'no specialist can provide it' WHEN fresh = 0 THEN 'already performed' ELSE 'assigned' END AS reason FROM r LEFT JOIN f ON f.repo_id = r.repo_id AND f.request_id = r.request_id) GROUP BY reason""",
)
def request_decisions(spark, sf_dir):
    requests = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
        .distinct()
        .selectExpr(
            "l_suppkey % 50 AS repo_id",
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id",
            "CASE l_partkey % 5 WHEN 0 THEN 'impact_analysis' WHEN 1 THEN 'benchmark' WHEN 2 THEN 'usage_analysis' WHEN 3 THEN 'test_coverage' ELSE 'other' END AS required_evidence",
            "concat('pkg', l_partkey % 20) AS package",
            "'1.0' AS current_version",
            "CASE WHEN l_linenumber % 2 = 0 THEN '2.0' END AS target_version",
            "CAST(NULL AS STRING) AS target_agent",
        )
    )
    unavailable = requests.where("repo_id % 2 = 0").select("repo_id", F.lit("performance_agent").alias("agent")).distinct()
    planned = orchestrate.follow_ups(requests, unavailable)
    completed = planned.where(F.col("focus").startswith("pkg1")).select("repo_id", "task_key").distinct()
    decided = orchestrate.decide_requests(requests, planned, completed)
    return decided.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "next_phases",
    """SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 19 = 0 THEN 'finalize' WHEN c_custkey % 3 = 0 THEN 'dispatch' WHEN c_custkey % 5 > c_custkey % 4 AND c_custkey % 7 < 3 THEN 'correlate'
      WHEN c_custkey % 2 > 0 AND c_custkey % 11 < 2 THEN 'verify' ELSE 'assess' END AS next_step FROM customer""",
)
def next_phases(spark, sf_dir):
    key = F.col("c_custkey")
    cases = table(spark, sf_dir, "customer").select(
        key.alias("repo_id"),
        (key % 19 == 0).alias("cancelled"),
        F.lit(0).alias("retries"),
        (key % 3 == 0).cast("int").alias("follow_ups"),
        (key % 5).alias("version"),
        (key % 4).alias("correlated_version"),
        (key % 7).alias("correlation_rounds"),
        (key % 2).alias("pending"),
        (key % 11).alias("verification_rounds"),
    )
    return orchestrate.next_phase(cases).select("repo_id", "next_step")


@query(
    "execution_trace",
    """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS seq FROM trace)
    SELECT repo_id, seq, format('- **[{:03d}] `{}` → `{}`** (`{}`): {}', seq, sender, receiver, event_type, message) AS line FROM numbered""",
    uses=("trace",),
)
def execution_trace(spark, sf_dir):
    numbered = sequence.with_sequence(adapt(spark, sf_dir, "trace"), ["repo_id"], "ts", "event_id")
    return numbered.select("repo_id", "seq", reports.event_line().alias("line"))


@query(
    "agent_retries",
    """SELECT run_id, attempt <= 2 AND error_type <> 'ValueError' AS retry, CASE WHEN attempt <= 2 AND error_type <> 'ValueError' THEN CASE WHEN agent = 'performance_agent' AND error_type = 'ToolUnavailableError' THEN 'static_only' ELSE strategy END END AS next_strategy
    FROM (SELECT *, CASE run_id % 3 WHEN 0 THEN 'ToolUnavailableError' WHEN 1 THEN 'Timeout' ELSE 'ValueError' END AS error_type FROM runs WHERE status = 'failed')""",
    uses=("runs",),
)
def agent_retries(spark, sf_dir):
    error = F.when(F.col("run_id") % 3 == 0, "ToolUnavailableError").when(F.col("run_id") % 3 == 1, "Timeout").otherwise("ValueError")
    failed = all_runs(spark, sf_dir).where("status = 'failed'").withColumns({"error_type": error, "retryable": F.lit(True)})
    return orchestrate.retries(failed, 2, ("ValueError",)).select("run_id", "retry", "next_strategy")


@query(
    "report_order",
    """SELECT repo_id, finding_id, row_number() OVER (PARTITION BY repo_id ORDER BY -complexity NULLS FIRST, finding_id) AS place FROM findings""",
    uses=("findings",),
)
def report_order(spark, sf_dir):
    """Findings of a report by falling complexity, then by number."""
    findings = adapt(spark, sf_dir, "findings").select("repo_id", "finding_id", "complexity")
    report = reports.case_report({"findings": (findings, [-F.col("complexity"), F.col("finding_id")])})
    placed = F.row_number().over(Window.partitionBy("repo_id").orderBy("order_key"))
    return report.select(
        "repo_id", F.get_json_object("item", "$.finding_id").cast("bigint").alias("finding_id"), placed.cast("bigint").alias("place")
    )

"""Queries on findings: confidence, risk, relationships, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import confidence, correlate, risk, verify
from riskframe.plans.registry import query
from riskframe.session import stage
from riskframe.sources.adapters import adapt

# ---- shared parts of the checks -----------------------------------------------------------------
STRENGTH_SQL = """strength AS (
  SELECT finding_id, least(0.95e0, 1 - product(1 - w * greatest(0e0, least(1e0, confidence)))) AS strength,
         count(*) AS evidence_count
  FROM (SELECT *, CAST(CASE source_type WHEN 'benchmark' THEN 0.92 WHEN 'test' THEN 0.88 WHEN 'dependency' THEN 0.8
               WHEN 'git' THEN 0.7 WHEN 'github' THEN 0.7 WHEN 'static_analysis' THEN 0.65
               WHEN 'llm_analysis' THEN 0.35 ELSE 0.4 END AS DOUBLE) AS w FROM evidence)
  GROUP BY finding_id)"""
CONFIDENCE_SQL = (
    STRENGTH_SQL
    + """, raw_scores AS (
  SELECT f.*, coalesce(evidence_count, 0) AS evidence_count,
    CASE WHEN evidence_count > 0 THEN strength ELSE 0.15e0 END
    + CASE WHEN reproduced THEN 0.10e0 ELSE 0e0 END
    + CASE WHEN reachability IN ('entrypoint', 'reachable') THEN 0.05e0 ELSE 0e0 END
    + CASE WHEN reachability = 'unreachable' THEN -0.25e0 ELSE 0e0 END
    + CASE WHEN corroborating_agents > 0 THEN least(0.15e0, 0.05e0 * corroborating_agents) ELSE 0e0 END
    + CASE WHEN static_suspect THEN -0.10e0 ELSE 0e0 END
    + CASE WHEN contradictions > 0 THEN -least(0.30e0, 0.15e0 * contradictions) ELSE 0e0 END
    + CASE WHEN status = 'verified' THEN 0.10e0 WHEN status = 'needs_more_evidence' THEN -0.10e0 ELSE 0e0 END AS raw
  FROM findings f LEFT JOIN strength USING (finding_id)),
capped AS (SELECT *, CASE WHEN is_hypothesis THEN least(raw, 0.40e0) ELSE raw END AS c1 FROM raw_scores),
scored AS (SELECT * EXCLUDE (raw, c1),
    round(greatest(0.01e0, least(0.99e0, CASE WHEN status = 'rejected' THEN least(c1, 0.10e0) ELSE c1 END)) + 1e-10, 3) AS confidence
  FROM capped)"""
)
RISK_SQL = (
    CONFIDENCE_SQL
    + """, factors AS (
  SELECT *, CAST(CASE WHEN impact IS NOT NULL THEN impact
      WHEN list_has_any(affected_components, ['authentication','authorization','cryptography','payments','secrets','session']) THEN 1.0
      WHEN category = 'license' THEN 0.6
      WHEN len(list_filter(affected_files, lambda x: NOT (test_only OR contains('/' || x, '/tests/')))) = 0 THEN 0.3
      WHEN category IN ('dependency', 'security') THEN 0.8 ELSE 0.7 END AS DOUBLE) AS impact_value,
    CAST(CASE WHEN likelihood IS NOT NULL THEN likelihood
      WHEN category IN ('security', 'dependency') THEN CASE reachability WHEN 'entrypoint' THEN 0.8 WHEN 'reachable' THEN 0.65
           WHEN 'unreachable' THEN 0.25 ELSE 0.5 END
      WHEN category = 'performance' THEN CASE WHEN measurement = 'measured' THEN 0.6 ELSE 0.35 END
      WHEN category = 'license' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS exploitability_value,
    CAST(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25
      ELSE 0.05 END AS DOUBLE) AS weight
  FROM scored),
verified_spots AS (
  SELECT DISTINCT repo_id, category, agent, created_at, finding_id, affected_file, affected_line
  FROM (SELECT *, unnest(lines) AS affected_line FROM (SELECT *, unnest(affected_files) AS affected_file FROM scored WHERE status = 'verified'))),
twins AS (
  SELECT DISTINCT b.finding_id FROM verified_spots b JOIN verified_spots a ON a.repo_id = b.repo_id AND a.category = b.category
    AND a.affected_file = b.affected_file AND a.affected_line = b.affected_line AND a.agent <> b.agent
    AND (a.created_at < b.created_at OR (a.created_at = b.created_at AND a.finding_id < b.finding_id))),
risks AS (
  SELECT repo_id, finding_id, severity, confidence, impact_value, exploitability_value,
    round(100 * (1 - exp(-2.2e0 * weight * confidence * impact_value * exploitability_value)) + 1e-10, 1) AS score
  FROM factors WHERE status = 'verified' AND severity <> 'info' AND finding_id NOT IN (SELECT finding_id FROM twins))"""
)


def scored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = confidence.context_from_findings(adapt(spark, sf_dir, "findings"))
    return confidence.with_confidence(findings, adapt(spark, sf_dir, "evidence"))


@query(
    "finding_confidence",
    f"WITH {CONFIDENCE_SQL} SELECT repo_id, finding_id, evidence_count, confidence FROM scored",
    uses=("findings", "evidence"),
)
def finding_confidence(spark, sf_dir):
    return scored_findings(spark, sf_dir).select(
        "repo_id", "finding_id", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "confidence"
    )


@query(
    "confidence_factors",
    f"""WITH {CONFIDENCE_SQL}, base AS (SELECT f.*, s.evidence_count AS n, strength FROM raw_scores f LEFT JOIN strength s USING (finding_id)),
    factor_rows AS (
      SELECT finding_id, 'evidence_strength' AS factor, CASE WHEN n > 0 THEN strength ELSE 0.15e0 END AS delta FROM base
      UNION ALL SELECT finding_id, 'reproduction', 0.10e0 FROM base WHERE reproduced
      UNION ALL SELECT finding_id, 'reachability', CASE WHEN reachability = 'unreachable' THEN -0.25e0 ELSE 0.05e0 END FROM base WHERE reachability IS NOT NULL
      UNION ALL SELECT finding_id, 'corroboration', least(0.15e0, 0.05e0 * corroborating_agents) FROM base WHERE corroborating_agents > 0
      UNION ALL SELECT finding_id, 'static_suspect', -0.10e0 FROM base WHERE static_suspect
      UNION ALL SELECT finding_id, 'contradiction', -least(0.30e0, 0.15e0 * contradictions) FROM base WHERE contradictions > 0
      UNION ALL SELECT finding_id, 'verification', CASE status WHEN 'verified' THEN 0.10e0 ELSE -0.10e0 END FROM base WHERE status IN ('verified', 'needs_more_evidence')
      UNION ALL SELECT finding_id, 'hypothesis_cap', 0.40e0 - raw FROM base WHERE is_hypothesis AND raw > 0.40e0
      UNION ALL SELECT finding_id, 'rejected_cap', 0.10e0 - c1 FROM (SELECT *, CASE WHEN is_hypothesis THEN least(raw, 0.40e0) ELSE raw END AS c1 FROM base)
        WHERE status = 'rejected' AND c1 > 0.10e0)
    SELECT finding_id, factor, round(delta + 1e-10, 3) AS delta FROM factor_rows""",
    uses=("findings", "evidence"),
)
def confidence_factors(spark, sf_dir):
    return (
        scored_findings(spark, sf_dir)
        .select("finding_id", F.explode("confidence_factors").alias("f"))
        .select("finding_id", "f.factor", "f.delta")
    )


@query(
    "finding_risk",
    f"""WITH {RISK_SQL} SELECT repo_id, finding_id, severity, confidence, impact_value, exploitability_value, score,
    CASE WHEN score >= 80 THEN 'P0' WHEN score >= 60 THEN 'P1' WHEN score >= 35 THEN 'P2' WHEN score >= 12 THEN 'P3' ELSE 'P4' END AS priority
    FROM risks""",
    uses=("findings", "evidence"),
)
def finding_risk(spark, sf_dir):
    return risk.finding_risks(scored_findings(spark, sf_dir)).select(
        "repo_id", "finding_id", "severity", "confidence", "impact_value", "exploitability_value", "score", "priority"
    )


OVERALL_SQL = f"""WITH {RISK_SQL}, ranked AS (
      SELECT repo_id, score, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC) AS rn FROM risks),
    overall AS (SELECT repo_id, round(100 * (1 - product(1 - score / 100 * pow(0.5e0, rn - 1))) + 1e-10, 1) AS overall_score
      FROM ranked WHERE rn <= 10 GROUP BY repo_id)
    SELECT repo_id, overall_score, CASE WHEN overall_score >= 80 THEN 'critical' WHEN overall_score >= 60 THEN 'high'
      WHEN overall_score >= 35 THEN 'medium' WHEN overall_score >= 12 THEN 'low' ELSE 'minimal' END AS level FROM overall"""


@query("overall_risk", OVERALL_SQL, uses=("findings", "evidence"))
def overall_risk(spark, sf_dir):
    return risk.overall_risk(risk.finding_risks(scored_findings(spark, sf_dir)))


# ---- relationships --------------------------------------------------------------------------------
TEST_PATH_SQL = r"'(^|/)(tests?|__tests__|spec|specs|testing)(/|$)|(^|/)(test_[^/]+\.py|[^/]+_test\.(py|go)|[^/]+\.(test|spec)\.[jt]sx?)$'"
CRITICAL_SQL = "('authentication', 'authorization', 'cryptography', 'payments', 'secrets', 'session')"
MEMBERS_SQL = (
    CONFIDENCE_SQL
    + f""", live AS (
  SELECT *, list_distinct(list_transform(list_concat(coalesce(packages, []), CASE WHEN package IS NULL THEN [] ELSE [package] END), lambda p: lower(p))) AS pkgs,
    coalesce(stance = 'acceptable', false) AS accepts, row_number() OVER (ORDER BY created_at, finding_id) AS born
  FROM scored WHERE status <> 'rejected'),
c1_pairs AS (
  SELECT repo_id, 'contradiction:' || subject AS signature,
    arg_min(finding_id, born) FILTER (severity <> 'info' AND NOT accepts) AS issue, arg_min(finding_id, born) FILTER (accepts) AS ok
  FROM live GROUP BY repo_id, subject HAVING issue IS NOT NULL AND ok IS NOT NULL),
c2_groups AS (
  SELECT repo_id, lower(package) AS pkg, arg_min(finding_id, born) AS first FROM live
  WHERE category = 'dependency' AND package IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
file_rows AS (SELECT DISTINCT repo_id, finding_id, category, unnest(affected_files) AS fpath FROM live),
pkg_rows AS (SELECT repo_id, finding_id, category, unnest(pkgs) AS pkg FROM live),
c3_v AS (SELECT repo_id, lower(package) AS pkg, arg_max(finding_id, born) AS v FROM live
  WHERE category = 'dependency' AND vulnerable AND package IS NOT NULL GROUP BY ALL),
c3_u AS (SELECT DISTINCT repo_id, pkg, p.finding_id FROM pkg_rows p JOIN c3_v USING (repo_id, pkg) WHERE category NOT IN ('dependency', 'testing')),
c3_files AS (SELECT DISTINCT u.repo_id, pkg, fpath FROM c3_u u JOIN file_rows f ON u.repo_id = f.repo_id AND u.finding_id = f.finding_id),
c3_used AS (SELECT DISTINCT repo_id, pkg FROM c3_u),
c3_t AS (SELECT f.repo_id, pkg, f.finding_id FROM file_rows f JOIN c3_files c ON f.repo_id = c.repo_id AND f.fpath = c.fpath WHERE category = 'testing'
  UNION SELECT p.repo_id, p.pkg, p.finding_id FROM pkg_rows p JOIN c3_used USING (repo_id, pkg) WHERE category = 'testing'),
c3_m AS (SELECT repo_id, pkg, v AS finding_id, true AS is_lead FROM c3_v JOIN c3_used USING (repo_id, pkg)
  UNION ALL SELECT repo_id, pkg, finding_id, false FROM c3_u UNION ALL SELECT repo_id, pkg, finding_id, false FROM c3_t),
c4_rows AS (
  SELECT repo_id, finding_id, born, category = 'security' AS sec, component FROM (SELECT *, unnest(list_distinct(affected_components)) AS component FROM live EXCLUDE_COMPONENT)
  WHERE component IN {CRITICAL_SQL} AND (category = 'testing' OR (category = 'security' AND rule_id NOT IN ('security.vulnerable_dependency_usage', 'security.hardcoded_secret')
    AND len(list_filter(affected_files, lambda x: NOT regexp_matches(x, {TEST_PATH_SQL}))) > 0))),
c4_groups AS (SELECT repo_id, component, count(*) FILTER (sec) AS n_sec, arg_min(finding_id, born) FILTER (sec) AS first
  FROM c4_rows GROUP BY ALL HAVING (n_sec >= 2 AND count(*) FILTER (NOT sec) > 0) OR n_sec >= 3),
c5_q AS (SELECT DISTINCT l.repo_id, l.finding_id, fpath FROM live l JOIN file_rows f USING (repo_id, finding_id) WHERE l.category = 'code_quality' AND NOT l.accepts),
c5_p AS (SELECT l.repo_id, 'perfarch:' || affected_files[1] || ':' || rule_id AS signature, arg_max(l.finding_id, born) AS p
  FROM live l WHERE category = 'performance' AND EXISTS (SELECT 1 FROM file_rows f JOIN c5_q q ON f.repo_id = q.repo_id AND f.fpath = q.fpath WHERE f.repo_id = l.repo_id AND f.finding_id = l.finding_id)
  GROUP BY ALL),
c6_rows AS (SELECT repo_id, finding_id, born, category = 'maintenance' AS m FROM live
  WHERE (category = 'maintenance' AND rule_id IN ('maintenance.inactive', 'maintenance.archived', 'maintenance.bus_factor')) OR (category = 'dependency' AND vulnerable)),
c6_groups AS (SELECT repo_id, arg_min(finding_id, born) FILTER (m) AS first FROM c6_rows GROUP BY ALL HAVING count(*) FILTER (m) > 0 AND count(*) FILTER (NOT m) > 0),
c7_d AS (SELECT repo_id, pkg, arg_max(finding_id, born) AS d FROM (SELECT *, unnest(list_distinct(packages)) AS pkg FROM live WHERE rule_id = 'dependency.unpinned') GROUP BY ALL),
c7_r AS (SELECT p.repo_id, pkg, p.finding_id FROM pkg_rows p JOIN c7_d USING (repo_id, pkg) WHERE category <> 'dependency'),
c8_spots AS (SELECT repo_id, category, agent, born, finding_id, fpath, unnest(list_distinct(lines)) AS line FROM live JOIN (SELECT repo_id AS r2, finding_id AS f2, fpath FROM file_rows) ON r2 = repo_id AND f2 = finding_id),
c8_pairs AS (
  SELECT DISTINCT b.repo_id, arg_min(a.finding_id, a.born) AS lead_id, b.finding_id FROM c8_spots b JOIN c8_spots a
    ON a.repo_id = b.repo_id AND a.category = b.category AND a.fpath = b.fpath AND a.line = b.line AND a.agent <> b.agent AND a.born < b.born
  GROUP BY b.repo_id, b.category, b.fpath, b.line, b.finding_id),
links AS (
  SELECT repo_id, signature, issue AS finding_id, true AS is_lead, 'contradiction' AS kind, 1e0 AS mult, 0.9e0 AS strength, 0 AS gen FROM c1_pairs
  UNION ALL SELECT repo_id, signature, ok, false, 'contradiction', 1e0, 0.9e0, 0 FROM c1_pairs
  UNION ALL SELECT l.repo_id, 'root:' || pkg, l.finding_id, l.finding_id = first, 'shared_root_cause', 1e0, 0.95e0, 1 FROM live l JOIN c2_groups g ON l.repo_id = g.repo_id AND lower(l.package) = pkg WHERE category = 'dependency'
  UNION ALL SELECT c.repo_id, 'compound:dep:' || pkg, c.finding_id, is_lead, 'compound_risk', least(2e0, 1 + 0.25e0 * (dims - 1)), 0.95e0, 2 FROM c3_m c
    JOIN (SELECT m.repo_id, pkg, count(DISTINCT category) AS dims FROM c3_m m JOIN live l ON l.finding_id = m.finding_id GROUP BY ALL) USING (repo_id, pkg)
  UNION ALL SELECT r.repo_id, 'cluster:' || component, r.finding_id, r.finding_id = first, 'compound_risk', least(1.5e0, 1 + 0.1e0 * n_sec), 0.8e0, 3 FROM c4_rows r JOIN c4_groups USING (repo_id, component)
  UNION ALL SELECT repo_id, signature, p, true, 'causal', 1.1e0, 0.8e0, 4 FROM c5_p
  UNION ALL SELECT DISTINCT q.repo_id, signature, q.finding_id, false, 'causal', 1.1e0, 0.8e0, 4 FROM c5_p c JOIN file_rows f ON f.repo_id = c.repo_id AND f.finding_id = c.p JOIN c5_q q ON q.repo_id = f.repo_id AND q.fpath = f.fpath
  UNION ALL SELECT repo_id, 'maint:dep', finding_id, finding_id = first, 'compound_risk', 1.3e0, 0.75e0, 5 FROM c6_rows JOIN c6_groups USING (repo_id)
  UNION ALL SELECT repo_id, 'deplink:' || pkg, d, true, 'dependency', 1.05e0, 0.85e0, 6 FROM c7_d WHERE (repo_id, pkg) IN (SELECT repo_id, pkg FROM c7_r)
  UNION ALL SELECT repo_id, 'deplink:' || pkg, finding_id, false, 'dependency', 1.05e0, 0.85e0, 6 FROM c7_r
  UNION ALL SELECT DISTINCT repo_id, 'dup:' || least(lead_id, finding_id) || ':' || greatest(lead_id, finding_id), unnest([lead_id, finding_id]), unnest([true, false]), 'duplicate', 1e0, 0.9e0, 7 FROM c8_pairs),
headers AS (
  SELECT l.repo_id, signature, kind, mult, strength, gen, count(*) AS n_members, count(DISTINCT agent) AS n_agents,
    round(greatest(0.05e0, least(0.99e0, exp(avg(ln(greatest(0.01e0, confidence)))) * strength)) + 1e-10, 3) AS confidence
  FROM links l JOIN scored s ON s.finding_id = l.finding_id GROUP BY l.repo_id, signature, kind, mult, strength, gen)"""
).replace("live EXCLUDE_COMPONENT", "(SELECT * EXCLUDE (component) FROM live)")


def correlated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings and the members of all candidate relationships, both staged: every generator and ruling reads them.

    What no relationship reads is dropped before: the kinds of evidence aren't gathered, members carry no facts but those ruled by.
    """
    findings = stage(scored_findings(spark, sf_dir).drop("confidence_factors", "source_types"))
    return findings, stage(correlate.candidate_members(findings).drop("category", "severity", "created_at"))


def ruled_correlations(members: DataFrame) -> DataFrame:
    """Candidates of staged members, ruled by the statuses the members carry: assessed and counted in one pass."""
    return verify.rule_on_correlations(correlate.assess(members, *verify.status_counts()))


def _generator_query(name: str, generate, kind_filter: str):
    @query(
        name,
        f"""WITH {MEMBERS_SQL} SELECT repo_id, signature, finding_id, is_lead, round(mult + 1e-10, 2) AS risk_multiplier
        FROM links WHERE {kind_filter}""",
        uses=("findings", "evidence"),
    )
    def run(spark, sf_dir):
        findings = correlate.open_findings(scored_findings(spark, sf_dir))
        return generate(findings).select("repo_id", "signature", "finding_id", "is_lead", "risk_multiplier")

    return run


_generator_query("contradictions", correlate.contradictions, "gen = 0")
_generator_query("shared_root_cause", correlate.shared_root_causes, "gen = 1")
_generator_query("dependency_compounds", correlate.dependency_compounds, "gen = 2")
_generator_query("component_clusters", correlate.component_clusters, "gen = 3")
_generator_query("performance_in_complex_code", correlate.performance_in_complex_code, "gen = 4")
_generator_query("maintenance_and_dependencies", correlate.maintenance_and_dependencies, "gen = 5")
_generator_query("dependency_links", correlate.dependency_links, "gen = 6")
_generator_query("duplicate_reports", correlate.duplicates, "gen = 7")


@query(
    "correlation_assessment",
    f"""WITH {MEMBERS_SQL} SELECT repo_id, signature, kind AS relationship_type, round(mult + 1e-10, 2) AS risk_multiplier,
    n_members, n_agents, confidence FROM headers""",
    uses=("findings", "evidence"),
)
def correlation_assessment(spark, sf_dir):
    _findings, members = correlated(spark, sf_dir)
    return correlate.assess(members).select(
        "repo_id",
        "signature",
        "relationship_type",
        "risk_multiplier",
        "n_members",
        F.col("n_agents").cast("bigint").alias("n_agents"),
        "confidence",
    )


@query(
    "correlation_member_updates",
    f"""WITH {MEMBERS_SQL}, per AS (
      SELECT l.repo_id, l.finding_id, s.status AS old_status, l.kind, CASE WHEN h.n_agents > 1 AND l.kind IN ('compound_risk', 'causal', 'shared_root_cause') THEN least(3, h.n_agents - 1) END AS others,
        l.gen, l.signature
      FROM links l JOIN headers h ON h.repo_id = l.repo_id AND h.signature = l.signature JOIN scored s ON s.finding_id = l.finding_id)
    SELECT repo_id, finding_id, CASE WHEN any_value(old_status) = 'proposed' THEN 'correlated' ELSE any_value(old_status) END AS status,
      max(CASE WHEN kind = 'contradiction' THEN 1 END) AS contradictions,
      arg_max(others, (gen, signature)) FILTER (others IS NOT NULL) AS corroborating_agents
    FROM per GROUP BY repo_id, finding_id""",
    uses=("findings", "evidence"),
)
def correlation_member_updates(spark, sf_dir):
    _findings, members = correlated(spark, sf_dir)
    return correlate.member_updates(members).select(
        "repo_id", "finding_id", "status", "contradictions", F.col("corroborating_agents").cast("bigint").alias("corroborating_agents")
    )


RULING_SQL = (
    MEMBERS_SQL
    + """, tallies AS (
  SELECT l.repo_id, l.signature, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (status NOT IN ('verified', 'rejected')) AS pending, max(CASE WHEN is_lead THEN status END) AS lead_status
  FROM links l JOIN scored s ON s.finding_id = l.finding_id GROUP BY ALL),
decisions AS (
  SELECT h.*, verified, rejected, pending, CASE WHEN kind = 'contradiction' THEN CASE WHEN verified > 0 AND rejected > 0 THEN 'verified' ELSE 'needs_more_evidence' END
    WHEN verified >= 2 AND lead_status <> 'rejected' THEN 'verified' WHEN pending > 0 AND verified + pending >= 2 THEN 'needs_more_evidence' ELSE 'rejected' END AS decision
  FROM headers h JOIN tallies t ON h.repo_id = t.repo_id AND h.signature = t.signature),
ruled AS (
  SELECT *, CASE WHEN kind = 'contradiction' AND decision = 'verified' THEN 'resolved' WHEN kind = 'contradiction' AND pending = 0 THEN 'rejected'
    WHEN decision = 'needs_more_evidence' THEN 'proposed' ELSE decision END AS ruling FROM decisions)"""
)


@query(
    "correlation_ruling",
    f"""WITH {RULING_SQL} SELECT repo_id, signature, verified, rejected, pending, decision, ruling AS status FROM ruled""",
    uses=("findings", "evidence"),
)
def correlation_ruling(spark, sf_dir):
    _findings, members = correlated(spark, sf_dir)
    ruled = ruled_correlations(members)
    return ruled.select("repo_id", "signature", "verified", "rejected", "pending", "decision", "status")


SCORE_SQL = "round(100 * (1 - exp(-2.2e0 * {w} * {c} * {i} * {e} * {m})) + 1e-10, 1)"


@query(
    "finding_risk_with_links",
    "WITH "
    + RISK_SQL
    + RULING_SQL[len(CONFIDENCE_SQL) :]
    + """, dropped AS (SELECT DISTINCT b.repo_id, b.finding_id FROM c8_spots b
      JOIN c8_spots a ON a.repo_id = b.repo_id AND a.category = b.category AND a.fpath = b.fpath AND a.line = b.line AND a.agent <> b.agent AND a.born < b.born
      JOIN scored sa ON sa.finding_id = a.finding_id JOIN scored sb ON sb.finding_id = b.finding_id WHERE sa.status = 'verified' AND sb.status = 'verified'),
    best AS (SELECT l.repo_id, l.finding_id, max(round(r.mult + 1e-10, 2)) AS multiplier, arg_min(l.signature, (-r.mult, l.signature)) AS via
      FROM links l JOIN ruled r ON r.repo_id = l.repo_id AND r.signature = l.signature WHERE r.kind IN ('causal', 'dependency') AND ruling = 'verified' GROUP BY ALL)
    SELECT f.repo_id, f.finding_id, coalesce(multiplier, 1e0) AS multiplier, via, """
    + SCORE_SQL.format(w="weight", c="confidence", i="impact_value", e="exploitability_value", m="coalesce(multiplier, 1e0)")
    + """ AS score FROM factors f LEFT JOIN best b ON b.repo_id = f.repo_id AND b.finding_id = f.finding_id
    WHERE status = 'verified' AND severity <> 'info' AND f.finding_id NOT IN (SELECT finding_id FROM dropped)""",
    uses=("findings", "evidence"),
)
def finding_risk_with_links(spark, sf_dir):
    findings, members = correlated(spark, sf_dir)
    ruled = stage(ruled_correlations(members))
    return risk.finding_risks(findings, ruled, members).select("repo_id", "finding_id", "multiplier", "via", "score")


@query(
    "compound_risk",
    "WITH "
    + RISK_SQL
    + RULING_SQL[len(CONFIDENCE_SQL) :]
    + """, worst AS (SELECT l.repo_id, l.signature, count(*) AS verified_members, arg_max(f.severity, f.weight) AS severity, max(f.weight) AS w,
        max(impact_value) AS i, max(exploitability_value) AS e, count(DISTINCT f.category) AS dimensions
      FROM links l JOIN factors f ON f.finding_id = l.finding_id WHERE f.status = 'verified' GROUP BY ALL HAVING count(*) >= 2)
    SELECT r.repo_id, r.signature, w.severity, verified_members, dimensions, """
    + SCORE_SQL.format(w="w", c="r.confidence", i="i", e="e", m="round(r.mult + 1e-10, 2)")
    + """ AS score FROM ruled r JOIN worst w ON w.repo_id = r.repo_id AND w.signature = r.signature
    WHERE kind IN ('compound_risk', 'causal') AND ruling = 'verified'""",
    uses=("findings", "evidence"),
)
def compound_risk(spark, sf_dir):
    findings, members = correlated(spark, sf_dir)
    ruled = stage(ruled_correlations(members))
    return risk.compound_risks(findings, ruled, members).select(
        "repo_id",
        "signature",
        "severity",
        "verified_members",
        F.col("dimensions").cast("bigint").alias("dimensions"),
        "score",
    )


@query(
    "excluded_findings",
    f"""WITH {RULING_SQL}, dropped AS (SELECT DISTINCT b.repo_id, b.finding_id FROM c8_spots b
      JOIN c8_spots a ON a.repo_id = b.repo_id AND a.category = b.category AND a.fpath = b.fpath AND a.line = b.line AND a.agent <> b.agent AND a.born < b.born
      JOIN scored sa ON sa.finding_id = a.finding_id JOIN scored sb ON sb.finding_id = b.finding_id WHERE sa.status = 'verified' AND sb.status = 'verified')
    SELECT repo_id, finding_id, status, CASE WHEN status = 'rejected' THEN 'rejected by verification' WHEN status <> 'verified' THEN 'insufficient evidence (not verified)'
      ELSE 'duplicate of another verified finding' END AS reason
    FROM scored WHERE severity <> 'info' AND (status <> 'verified' OR finding_id IN (SELECT finding_id FROM dropped))""",
    uses=("findings", "evidence"),
)
def excluded_findings(spark, sf_dir):
    findings, _members = correlated(spark, sf_dir)
    return risk.excluded_findings(findings)


@query(
    "correlation_upsert",
    f"WITH {RULING_SQL} SELECT repo_id, signature, CASE WHEN kind = 'compound_risk' THEN 'proposed' ELSE 'verified' END AS status FROM headers",
    uses=("findings", "evidence"),
)
def correlation_upsert(spark, sf_dir):
    """All relationships were verified; then the lead of each compound risk is exchanged for another finding."""
    _findings, members = correlated(spark, sf_dir)
    exchanged = F.when(F.col("is_lead") & (F.col("relationship_type") == "compound_risk"), F.col("finding_id") + 1_000_000_000)
    current = correlate.assess(members).withColumn("status", F.lit("verified"))
    incoming = correlate.assess(members.withColumn("finding_id", F.coalesce(exchanged, F.col("finding_id"))))
    return correlate.upsert_correlations(current, incoming).select("repo_id", "signature", "status")

"""Relationships, verification and planning on small finding sets."""

import itertools

from pyspark.sql import functions as F

from riskframe.operators import code_rules, correlate, orchestrate, recommend, risk, sequence, verify
from riskframe.session import stage
from riskframe.sources.adapters import adapt
from riskframe.sources.pyfacts import python_facts

SF = "/root/testdata/sf0.001"
COLUMNS = (
    "repo_id string, finding_id int, agent string, category string, rule_id string, severity string, status string, subject string, "
    "affected_files array<string>, affected_components array<string>, lines array<int>, stance string, measurement string, "
    "package string, packages array<string>, version string, vulnerable boolean, confidence double, created_at int"
)


def finding(i, **kw):
    base = dict(
        repo_id="r",
        finding_id=i,
        agent=f"agent{i}",
        category="security",
        rule_id="security.x",
        severity="high",
        status="proposed",
        subject=None,
        affected_files=[],
        affected_components=[],
        lines=[],
        stance=None,
        measurement=None,
        package=None,
        packages=None,
        version=None,
        vulnerable=False,
        confidence=0.8,
        created_at=i,
    )
    return {**base, **kw}


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


def test_compound_from_three_dimensions(spark):
    findings = frame(
        spark,
        finding(1, category="dependency", rule_id="dependency.vulnerable", package="PyJWT", version="1.7.1", vulnerable=True),
        finding(2, package="pyjwt", affected_files=["auth/a.py"]),
        finding(3, category="testing", affected_files=["auth/a.py"]),
        finding(4, category="testing", affected_files=["other.py"]),
    )
    members = correlate.dependency_compounds(correlate.open_findings(findings)).collect()
    assert {(m.finding_id, m.is_lead) for m in members} == {(1, True), (2, False), (3, False)}
    assert {m.risk_multiplier for m in members} == {1.5} and {m.signature for m in members} == {"compound:dep:pyjwt"}


def test_contradiction_and_ruling(spark):
    findings = frame(
        spark,
        finding(1, category="performance", subject="s", measurement="measured", status="verified", severity="medium"),
        finding(2, category="code_quality", subject="s", stance="acceptable", severity="info", status="rejected"),
    )
    members = correlate.contradictions(correlate.open_findings(findings.withColumn("status", F.lit("proposed"))))
    assert [(m.finding_id, m.is_lead) for m in members.orderBy("finding_id").collect()] == [(1, True), (2, False)]
    ruled = verify.rule_on_correlations(correlate.assess(members), members, findings).first()
    assert ruled.status == "resolved" and ruled.decision == "verified"


def test_duplicate_links_find_the_same_later_reports_as_all_pairs(spark):
    rows = adapt(spark, SF, "findings").withColumn("confidence", F.lit(0.5))
    live = rows.where("status <> 'rejected'").select("repo_id", "finding_id", "category", "agent", "affected_files", "lines", "created_at").collect()
    later = set()
    for a, b in itertools.combinations(sorted(live, key=lambda r: (r.created_at, r.finding_id)), 2):
        same = a.repo_id == b.repo_id and a.category == b.category and a.agent != b.agent
        if same and set(a.affected_files) & set(b.affected_files) and set(a.lines) & set(b.lines):
            later.add(b.finding_id)
    links = correlate.duplicate_links(correlate.open_findings(rows)).collect()
    assert {x.finding_id for x in links} == later and later


def test_checks_and_policy(spark):
    findings = frame(
        spark,
        finding(1, category="dependency", rule_id="dependency.vulnerable", package="x", vulnerable=True),
        finding(2, rule_id="security.hardcoded_secret", affected_files=["docs/a.md"]),
        finding(3, category="performance", severity="medium", measurement="static_suspect"),
        finding(4, category="maintenance"),
    ).withColumns(
        {
            "placeholder_values": F.when(F.col("finding_id") == 2, F.lit(1).cast("bigint")),
            "mismatched_items": F.when(F.col("finding_id") == 4, F.lit(1).cast("bigint")),
            "advisory_max_severity": F.lit("medium"),
            "complexity": F.lit(None).cast("bigint"),
        }
    )
    decided = {r.finding_id: r for r in verify.decide(verify.count_own_checks(verify.with_checks(findings))).collect()}
    assert (decided[1].decision, decided[1].adjusted_severity) == ("verified", "medium")
    assert decided[2].decision == "rejected"
    assert decided[3].decision == "needs_more_evidence"
    assert decided[4].decision == "rejected"


def test_compound_members_are_not_recommended_twice(spark):
    findings = frame(
        spark,
        finding(1, category="dependency", rule_id="dependency.vulnerable", package="x", version="1", vulnerable=True, status="verified", severity="critical"),
        finding(2, rule_id="security.jwt_no_algorithms", status="verified", severity="critical"),
        finding(3, rule_id="security.weak_password_hash", status="verified", severity="critical"),
    ).withColumns({"title": F.col("rule_id"), "impact": F.lit(1.0), "likelihood": F.lit(1.0), "test_only": F.lit(False), "reachability": F.lit(None).cast("string")})
    members = spark.createDataFrame([("r", "c", 1, True), ("r", "c", 2, False)], "repo_id string, signature string, finding_id int, is_lead boolean")
    link = spark.createDataFrame([("r", "c", "compound_risk", "verified", 1.5, 0.9)], "repo_id string, signature string, relationship_type string, status string, risk_multiplier double, confidence double")
    compounds = risk.compound_risks(findings, link, members)
    rows = recommend.recommendations(risk.finding_risks(findings), compounds, members, findings).collect()
    assert {(r.kind, r.risk_key) for r in rows} == {("compound", "c"), ("finding", "3")}
    assert next(r for r in rows if r.kind == "compound").fix.startswith("1. Upgrade x")


def test_rate_limit_against_a_plain_replay(spark):
    import random

    rng = random.Random(3)
    hits, t = [], 1_700_000_000.0
    for i in range(400):
        t += rng.choice([0.5, 2, 5, 30, 90])
        hits.append((rng.choice("ab"), i, t))
    want, window = {}, {}
    for client, i, at in hits:
        kept = [x for x in window.get(client, []) if at - x <= 60]
        want[i] = len(kept) < 3
        window[client] = [*kept, at] if want[i] else kept
    df = spark.createDataFrame(hits, "client string, id int, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")))
    got = sequence.rate_limit_decisions(df.select("client", "id", "ts"), "client", "ts", "id", per_minute=3)
    assert {r.id: r.accepted for r in got.collect()} == want


def test_peak_parallelism_counts_ends_before_starts(spark):
    rows = [("r", 0, 10), ("r", 10, 20), ("r", 5, 12), ("r", 3600, 3700), ("r", 11, 7300)]
    df = spark.createDataFrame(rows, "repo_id string, s int, e int").selectExpr("repo_id", "timestamp_seconds(s) AS started_at", "timestamp_seconds(e) AS completed_at")
    assert sequence.peak_parallelism(df, ["repo_id"], bucket_seconds=60).first().parallelism == 3


def test_code_facts_and_rules(spark):
    body = (
        "import jwt\nimport requests\n\ndef f(x):\n    for i in x:\n        if i and x:\n            db.execute('q', (i,))\n    return 1\n\n"
        "def login(tok):\n    return jwt.decode(tok, verify=False)\n"
    )
    test = "from pkg.a import f\n\ndef test_f():\n    f([])\n"
    files = spark.createDataFrame([("r", "pkg/a.py", body), ("r", "tests/test_a.py", test)], "repo_id string, path string, text string")
    facts = python_facts(files).cache()
    metrics = {r.name: r.complexity for r in facts.where("fact = 'function'").collect()}
    assert metrics["f"] == 4
    call = facts.where("fact = 'call' AND name = 'db.execute'").first()
    assert call.loop_line == 5
    assert {r.rule_id for r in code_rules.insecure_calls(facts).collect()} == {"security.jwt_verification_disabled"}
    assert {r.rule_id for r in code_rules.loop_suspects(facts).collect()} == {"performance.n_plus_one"}
    assert {r.rule_id for r in code_rules.test_findings(facts).collect()} == {"testing.no_assertions"}
    placed = code_rules.enclosing_function(facts.where("fact = 'call'").select("repo_id", "path", "line"), facts)
    assert {r.function for r in placed.where("path = 'pkg/a.py'").collect()} == {"f", "login"}


def test_next_phase(spark):
    rows = [(False, 1, 0, 5, 5, 0, 0, 0), (False, 0, 0, 6, 5, 0, 1, 0), (False, 0, 0, 5, 5, 0, 1, 0), (False, 0, 0, 5, 5, 0, 0, 0), (True, 1, 1, 9, 0, 0, 9, 0)]
    df = spark.createDataFrame(rows, "cancelled boolean, retries int, follow_ups int, version int, correlated_version int, correlation_rounds int, pending int, verification_rounds int")
    assert [r.next_step for r in orchestrate.next_phase(df).collect()] == ["dispatch", "correlate", "verify", "assess", "finalize"]


def test_ruling_from_statuses_the_members_carry_is_one_pass(spark):
    statuses = ("verified", "rejected", "proposed", "verified", "needs_more_evidence")
    rows = [finding(i, category="dependency", package=f"p{i // 3}", status=statuses[i % 5]) for i in range(24)]
    findings = frame(spark, *rows)
    members = stage(correlate.shared_root_causes(correlate.open_findings(findings)))
    apart = verify.rule_on_correlations(correlate.assess(members), members, findings)
    at_once = verify.rule_on_correlations(correlate.assess(members, *verify.status_counts()))
    columns = sorted(apart.columns)
    assert sorted(at_once.columns) == columns
    want = sorted(map(tuple, apart.select(*columns).collect()), key=repr)
    assert want and sorted(map(tuple, at_once.select(*columns).collect()), key=repr) == want
    assert "Join" not in at_once._jdf.queryExecution().optimizedPlan().toString()

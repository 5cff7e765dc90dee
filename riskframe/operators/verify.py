"""Checks against findings, the policy that rules on them, and the ruling on relationships.

Facts about a finding (hash results, import users, advisory evidence, contested sides) are joined to it once; all checks
are then one projection, and the policy counts them. A fact that is absent stays null and never counts as good news.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import advisory_rank, lookup, severity_rank, stable_round
from riskframe.functions.paths import is_fixture_path, is_test_path

FACTS = {
    "hashed_items": "bigint",
    "mismatched_items": "bigint",
    "commit_sha": "string",
    "head_sha": "string",
    "placeholder_values": "bigint",
    "real_values": "bigint",
    "production_refs": "bigint",
    "users": "bigint",
    "reach": "string",
    "evidence_severity": "string",
    "jwt_major": "int",
    "deployment_sets_variable": "boolean",
    "n_usage_files": "int",
    "rerun_exit": "int",
    "trusted": "boolean",
    "untested_files": "bigint",
    "test_evidence": "bigint",
    "recomputed_complexity": "bigint",
    "declared_licenses": "array<string>",
    "license_file": "string",
    "contested": "boolean",
    "other_measured": "boolean",
    "own_measured": "boolean",
}
METRIC_RULES = ("code_quality.high_complexity", "code_quality.long_function", "code_quality.deep_nesting")
UNTESTED_RULES = ("testing.untested_critical_path", "testing.untested_dependency_usage")


def needs_verification(contested: Column, evidence_count: Column, verified_evidence_count: Column) -> Column:
    """Open findings; those that lacked evidence only when there is more of it; info findings only when contested."""
    status = F.col("status")
    disputed = F.coalesce(contested, F.lit(False))
    return (
        F.when(status.isin("verified", "rejected"), F.lit(False))
        .when(
            status == "needs_more_evidence",
            (evidence_count > F.coalesce(verified_evidence_count, F.lit(0))) | disputed,
        )
        .when(F.col("severity") == "info", disputed)
        .otherwise(F.lit(True))
    )


def verification_queue(findings: DataFrame, per_repo: int = 60) -> DataFrame:
    """The worst findings first, a fixed number per repository. The limit applies before the shuffle as well."""
    order = Window.partitionBy("repo_id").orderBy(
        severity_rank(F.col("severity")).desc(), F.col("created_at"), F.col("finding_id")
    )
    return findings.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_repo)


# ------------------------------------------------------------------------------------------- facts
def integrity_facts(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Per finding: line ranges hashed again, and how many differ from the stored hash. Ranges of a gone file differ."""
    from riskframe.functions.text import line_range_hash

    claims = evidence.where(F.col("file").isNotNull() & F.col("content_hash").isNotNull())
    current = claims.join(files.select("repo_id", F.col("path").alias("file"), "text"), ["repo_id", "file"], "left")
    now = line_range_hash(F.col("text"), F.col("line_start"), F.col("line_end"))
    return (
        current.withColumn("_differs", ~F.coalesce(now == F.col("content_hash"), F.lit(False)))
        .groupBy("repo_id", "finding_id")
        .agg(F.count("*").alias("hashed_items"), F.count_if("_differs").alias("mismatched_items"))
    )


def advisory_facts(evidence: DataFrame, severity: str = "advisory_severity") -> DataFrame:
    """Per finding: the worst severity its advisory evidence names."""
    return (
        evidence.where(F.col(severity).isNotNull())
        .groupBy("finding_id")
        .agg(F.max_by(severity, F.struct(advisory_rank(F.col(severity)), F.col(severity))).alias("evidence_severity"))
    )


def measured_facts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("finding_id").agg(
        F.count_if(F.col("source_type").isin("benchmark", "test")).alias("_measured_items"),
        F.count_if(F.col("source_type") == "test").alias("test_evidence"),
        F.count("*").alias("evidence_count"),
    )


def contradiction_facts(contradiction_members: DataFrame, findings: DataFrame) -> DataFrame:
    """Per contested finding: does the other side of the contradiction rest on a measurement?"""
    sides = contradiction_members.select("repo_id", "signature", "finding_id").join(
        findings.select("repo_id", "finding_id", "measurement"), ["repo_id", "finding_id"]
    )
    measured = F.coalesce(F.col("measurement") == "measured", F.lit(False))
    totals = sides.groupBy("repo_id", "signature").agg(F.count_if(measured).alias("_all"))
    return (
        sides.join(totals, ["repo_id", "signature"])
        .withColumn("_others", F.col("_all") - measured.cast("int"))
        .groupBy("repo_id", "finding_id")
        .agg(F.lit(True).alias("contested"), (F.max("_others") > 0).alias("other_measured"))
    )


def dependency_use_facts(findings: DataFrame, import_users: DataFrame, reach: DataFrame) -> DataFrame:
    """Per package finding: production files that import it and the best reach among them.

    ``import_users(repo_id, path, root)`` are imports, ``reach(repo_id, path, reach)`` the reach of files.
    """
    users = (
        import_users.where(~is_test_path(F.col("path")))
        .join(reach, ["repo_id", "path"], "left")
        .groupBy("repo_id", "root")
        .agg(
            F.countDistinct("path").alias("users"),
            F.max(F.coalesce(F.col("reach") == "entrypoint", F.lit(False))).alias("_entry"),
        )
    )
    named = findings.where(F.col("package").isNotNull()).select(
        "repo_id", "finding_id", F.split_part("import_name", F.lit("."), F.lit(1)).alias("root")
    )
    return named.join(users, ["repo_id", "root"], "left").select(
        "repo_id",
        "finding_id",
        F.coalesce("users", F.lit(0)).alias("users"),
        F.when(F.col("_entry"), F.lit("entrypoint"))
        .when(F.col("users") > 0, F.lit("reachable"))
        .otherwise(F.lit("unreachable"))
        .alias("reach"),
    )


# ------------------------------------------------------------------------------------------ checks
def _check(name: str, outcome: Column | str, detail: Column | str, supports: Column | str | None = None) -> Column:
    def lit(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        F.lit(name).alias("check"),
        lit(outcome).alias("outcome"),
        lit(detail).alias("detail"),
        lit(supports).alias("supports"),
    )


def _fail_unless(name: str, good: Column, passed: str, failed: str, supports: str) -> Column:
    return F.when(good, _check(name, "pass", passed)).otherwise(_check(name, "fail", failed, supports))


def with_checks(findings: DataFrame) -> DataFrame:
    """Add ``checks``: every check that applies to the finding's rule and category, in order."""
    df = findings
    for name, kind in FACTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    category, rule = c("category"), c("rule_id")
    secret = rule == "security.hardcoded_secret"
    package_finding = (category == "dependency") & c("package").isNotNull()
    code_finding = category.isin("security", "api_compatibility") & ~secret
    performance = category == "performance"
    testing = category == "testing"
    copyleft = rule == "license.copyleft_file"

    integrity = (
        F.when(
            c("mismatched_items") > 0,
            _check("evidence_integrity", "fail", "evidence no longer matches the repository's lines", "rejection"),
        )
        .when(c("hashed_items") > 0, _check("evidence_integrity", "pass", "every referenced line range hashes as stored"))
        .otherwise(_check("evidence_integrity", "not_applicable", "evidence names no lines of the repository"))
    )
    stale = F.coalesce(c("commit_sha") != c("head_sha"), F.lit(False))
    staleness = _fail_unless(
        "staleness", ~stale, "evidence is from the analysed commit", "evidence is from an older commit", "more_evidence"
    )
    outside = (F.size("affected_files") > 0) & F.forall("affected_files", lambda f: is_test_path(f) | is_fixture_path(f))
    location = _fail_unless(
        "location_context", ~outside, "affected files are production code", "all files are tests or fixtures", "downgrade"
    )
    placeholder = (
        F.when(c("real_values") > 0, _check("placeholder", "pass", "a value has no sign of being a placeholder"))
        .when(
            c("placeholder_values") > 0,
            _check("placeholder", "fail", "every value is a documented placeholder", "rejection"),
        )
        .otherwise(_check("placeholder", "inconclusive", "values could not be read again", "more_evidence"))
    )
    production_reference = _fail_unless(
        "production_reference",
        F.coalesce(c("production_refs") > 0, F.lit(False)),
        "production code refers to the file",
        "no production code refers to the file",
        "rejection",
    )
    dependency_used = _fail_unless(
        "dependency_used",
        F.coalesce(c("users") > 0, F.lit(False)),
        "production modules import the package",
        "no production module imports the package",
        "downgrade",
    )
    top = F.coalesce(c("evidence_severity"), c("advisory_max_severity"))
    exaggerated = F.coalesce(severity_rank(c("severity")) > advisory_rank(top), F.lit(False))
    severity_justified = _fail_unless(
        "severity_justified",
        ~exaggerated,
        "severity is backed by the advisories",
        "severity exceeds the worst advisory",
        "downgrade",
    )
    reach = c("reach")
    reachability = (
        F.when(
            ~F.exists("affected_files", lambda f: f.endswith(".py")) | (F.size("affected_files") == 0),
            _check("reachability", "not_applicable", "no module to trace"),
        )
        .when(reach.isin("entrypoint", "reachable"), _check("reachability", "pass", F.concat(F.lit("reach: "), reach)))
        .when(reach == "test_only", _check("reachability", "fail", "only tests import the code", "downgrade"))
        .otherwise(_check("reachability", "inconclusive", "no static importers found"))
    )
    jwt_rule = rule == "security.jwt_no_algorithms"
    mitigation = F.when(
        jwt_rule,
        F.when(
            c("jwt_major") < 2, _check("mitigation", "pass", "the pinned release accepts the token header's algorithm")
        ).otherwise(_check("mitigation", "inconclusive", "newer releases refuse the call", "downgrade")),
    ).when(
        rule == "security.hardcoded_default_secret",
        F.when(
            F.coalesce(c("deployment_sets_variable"), F.lit(False)),
            _check("mitigation", "inconclusive", "deployment configuration sets the variable", "downgrade"),
        ).otherwise(_check("mitigation", "pass", "no deployment configuration sets the variable")),
    )
    usage_claim = _fail_unless(
        "usage_claim", F.coalesce(c("n_usage_files") > 0, F.lit(False)), "usage files are listed", "no usage files", "downgrade"
    )
    measurement = c("measurement")
    measured = (
        F.when(measurement == "measured", _check("reproduction", "pass", "benchmark confirms the claim"))
        .when(
            measurement == "measured_no_issue",
            _check("reproduction", "fail", "benchmark does not show the claimed growth", "rejection"),
        )
        .when(
            c("severity").isin("low", "info"),
            _check("theoretical_vs_actual", "pass", "low-severity suspect accepted unmeasured"),
        )
        .otherwise(_check("theoretical_vs_actual", "inconclusive", "suspect was never measured", "more_evidence"))
    )
    rerun = (
        F.when(
            ~F.coalesce(c("trusted"), F.lit(False)), _check("reproduction", "inconclusive", "code may not be executed here")
        )
        .when(c("rerun_exit") == 1, _check("reproduction", "pass", "failed again on another run"))
        .when(c("rerun_exit") == 0, _check("reproduction", "fail", "passed on another run", "more_evidence"))
        .otherwise(_check("reproduction", "inconclusive", "the other run did not finish"))
    )
    mapping = _fail_unless(
        "independent_mapping",
        F.coalesce(c("untested_files") > 0, F.lit(False)),
        "no test imports the files",
        "tests do import the files",
        "rejection",
    )
    coverage = F.when(c("test_evidence") > 0, _check("coverage_measurement", "pass", "coverage was measured"))
    reproduced = c("recomputed_complexity").isNotNull() & (
        (rule != "code_quality.high_complexity") | (c("recomputed_complexity") == c("complexity"))
    )
    recompute = _fail_unless("recompute", reproduced, "metric computed again", "metric could not be reproduced", "rejection")
    false_positive = _fail_unless(
        "false_positive",
        ~F.coalesce(F.array_contains("declared_licenses", c("license_file")), F.lit(False)),
        "the two licenses differ",
        "the declared expression includes the file's license",
        "rejection",
    )
    acceptable = F.coalesce(c("stance") == "acceptable", F.lit(False))
    contradiction = F.when(
        F.coalesce(c("contested"), F.lit(False)),
        F.when(
            acceptable & F.coalesce(c("other_measured"), F.lit(False)),
            _check("contradiction", "fail", "measured evidence contradicts the assessment", "rejection"),
        )
        .when(
            ~acceptable & F.coalesce(c("own_measured"), F.lit(False)),
            _check("contradiction", "pass", "the other side is not measured; this finding is"),
        )
        .otherwise(_check("contradiction", "inconclusive", "neither side settles it by measurement", "more_evidence")),
    )
    other = ~secret & ~package_finding & ~code_finding & ~performance & ~testing & ~category.isin("code_quality", "license")
    checks = F.array_compact(
        F.array(
            integrity,
            staleness,
            F.when(secret, location),
            F.when(secret, placeholder),
            F.when(secret, production_reference),
            F.when(package_finding, dependency_used),
            F.when(package_finding & F.coalesce(c("vulnerable"), F.lit(False)), severity_justified),
            F.when(code_finding | performance | copyleft, reachability),
            F.when(code_finding | copyleft, location),
            F.when(code_finding, mitigation),
            F.when(code_finding & (rule == "security.vulnerable_dependency_usage"), usage_claim),
            F.when(performance, measured),
            F.when(
                testing,
                F.when(rule == "testing.test_failure", rerun)
                .when(rule.isin(*UNTESTED_RULES), mapping)
                .otherwise(_check("recheck", "pass", "derived again from the tests")),
            ),
            F.when(testing & rule.isin(*UNTESTED_RULES), coverage),
            F.when((category == "code_quality") & rule.isin(*METRIC_RULES), recompute),
            F.when(rule == "license.metadata_mismatch", false_positive),
            F.when(other, _check("source_quality", "pass", "derived from deterministic history data")),
            contradiction,
        )
    )
    return df.withColumn("checks", checks)


# ------------------------------------------------------------------------------------------ policy
COUNTS = {
    "integrity_fails": lambda c: (c["check"] == "evidence_integrity") & (c["outcome"] == "fail"),
    "rejecting": lambda c: (c["outcome"] == "fail") & (c["supports"] == "rejection"),
    "wanting": lambda c: c["outcome"].isin("fail", "inconclusive") & (c["supports"] == "more_evidence"),
    "downgrading": lambda c: (c["outcome"] == "fail") & (c["supports"] == "downgrade"),
    "passed": lambda c: c["outcome"] == "pass",
    "failed": lambda c: c["outcome"] == "fail",
    "applicable": lambda c: c["outcome"] != "not_applicable",
}


def count_checks(checks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Checks in long form (one row each) counted per key."""
    row = {name: F.col(name) for name in ("check", "outcome", "supports")}
    return checks.groupBy(*keys).agg(
        *[F.count_if(F.coalesce(test(row), F.lit(False))).alias(name) for name, test in COUNTS.items()]
    )


def count_own_checks(findings: DataFrame) -> DataFrame:
    """Checks held in the row's ``checks`` array, counted without a shuffle."""
    return findings.withColumns({name: F.size(F.filter("checks", test)).cast("bigint") for name, test in COUNTS.items()})


def decide(counted: DataFrame) -> DataFrame:
    """The policy: broken evidence or a rejecting failure rejects; an open question waits; the rest is verified.

    Adds ``decision``, ``adjusted_severity`` (when ``severity`` is there) and ``verdict_confidence``.
    """
    c = F.col
    decision = (
        F.when((c("integrity_fails") > 0) | (c("rejecting") > 0), F.lit("rejected"))
        .when(c("wanting") > 0, F.lit("needs_more_evidence"))
        .otherwise(F.lit("verified"))
    )
    share = F.when(c("decision") == "rejected", c("failed")).otherwise(c("passed")) / F.greatest(c("applicable"), F.lit(1))
    out = counted.withColumn("decision", decision).withColumn(
        "verdict_confidence", stable_round(F.lit(0.5) + F.lit(0.5) * share, 3)
    )
    if "severity" in counted.columns:
        lower = (c("decision") == "verified") & (c("downgrading") > 0)
        out = out.withColumn("adjusted_severity", F.when(lower, lookup(c("severity"), C.DOWNGRADE)))
    return out


def counter_evidence(findings: DataFrame) -> DataFrame:
    """Failed checks that spoke for rejection or a lower severity, one row each."""
    return (
        findings.select("repo_id", "finding_id", F.explode("checks").alias("c"))
        .select("repo_id", "finding_id", "c.*")
        .where((F.col("outcome") == "fail") & F.col("supports").isin("rejection", "downgrade"))
        .select("repo_id", "finding_id", "check", "detail")
    )


def apply_decisions(decided: DataFrame) -> DataFrame:
    """Write decisions back: status, severity, reachability, evidence count; ready for the confidence to be recomputed."""
    resolved = (F.col("decision") == "verified") & F.exists(
        "checks", lambda c: (c["check"] == "contradiction") & (c["outcome"] == "pass")
    )
    reach = F.when(
        (F.col("category") == "dependency") | F.col("category").isin("security", "api_compatibility", "performance"),
        F.when(F.col("reach") == "test_only", F.lit("unreachable")).when(
            F.col("reach").isin("entrypoint", "reachable", "unreachable"), F.col("reach")
        ),
    )
    out = (
        decided.withColumn("status", F.col("decision"))
        .withColumn("original_severity", F.when(F.col("adjusted_severity").isNotNull(), F.col("severity")))
        .withColumn("severity", F.coalesce("adjusted_severity", "severity"))
        .withColumn("reachability", F.coalesce(reach, F.col("reachability")))
        .withColumn("contradictions", F.when(resolved, F.lit(0)).otherwise(F.col("contradictions")))
    )
    if "evidence_count" in decided.columns:
        out = out.withColumn("verified_evidence_count", F.col("evidence_count"))
    return out


def evidence_requests(decided: DataFrame, contradiction_members: DataFrame, existing: DataFrame) -> DataFrame:
    """One request per undecided finding that can still be settled: a benchmark, or a look at a secret's context.

    ``existing(repo_id, finding_id)`` are findings asked about before; those are not asked about again.
    """
    open_ones = decided.where(F.col("decision") == "needs_more_evidence").join(
        existing, ["repo_id", "finding_id"], "left_anti"
    )
    disputed = F.exists("checks", lambda c: c["check"] == "contradiction")
    performance = (
        contradiction_members.where(F.col("category") == "performance")
        .groupBy("repo_id", "signature")
        .agg(F.min("finding_id").alias("measured_id"))
    )
    partner = (
        contradiction_members.select("repo_id", "signature", "finding_id")
        .join(performance, ["repo_id", "signature"])
        .groupBy("repo_id", "finding_id")
        .agg(F.min("measured_id").alias("partner_id"))
    )
    wants_benchmark = (F.col("category") == "performance") | disputed
    target = F.when(F.col("category") == "performance", F.col("finding_id")).otherwise(F.col("partner_id"))
    return (
        open_ones.join(partner, ["repo_id", "finding_id"], "left")
        .select(
            "repo_id",
            "finding_id",
            F.when(wants_benchmark, F.lit("benchmark"))
            .when(F.col("rule_id") == "security.hardcoded_secret", F.lit("usage_analysis"))
            .alias("required_evidence"),
            F.when(wants_benchmark, target).otherwise(F.col("finding_id")).alias("target_finding_id"),
        )
        .where(F.col("required_evidence").isNotNull() & F.col("target_finding_id").isNotNull())
    )


# ----------------------------------------------------------------------------- ruling on relationships
def broken_package_links(members: DataFrame, findings: DataFrame, import_users: DataFrame) -> DataFrame:
    """Compounds on a package whose verified test findings touch no file that imports the package.

    ``import_users(repo_id, package, path)`` lists the files that import each package.
    """
    compounds = members.where(
        (F.col("relationship_type") == "compound_risk") & F.col("signature").startswith("compound:dep:")
    ).withColumn("package", F.replace(F.col("signature"), F.lit("compound:dep:"), F.lit("")))
    tests = findings.where((F.col("status") == "verified") & (F.col("category") == "testing")).select(
        "repo_id", "finding_id", F.explode("affected_files").alias("path")
    )
    touched = compounds.select("repo_id", "signature", "package", "finding_id").join(tests, ["repo_id", "finding_id"])
    hits = touched.join(import_users, ["repo_id", "package", "path"], "left_semi").select("repo_id", "signature").distinct()
    return touched.select("repo_id", "signature").distinct().join(hits, ["repo_id", "signature"], "left_anti")


def status_counts() -> list[Column]:
    """What a ruling needs of the members of a relationship: how many of each status, and the lead's."""
    s = F.col("status")
    return [
        F.count_if(s == "verified").alias("verified"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(~s.isin("verified", "rejected")).alias("pending"),
        F.max(F.when(F.col("is_lead"), s)).alias("lead_status"),
    ]


def rule_on_correlations(
    correlations: DataFrame, members: DataFrame | None = None, findings: DataFrame | None = None, broken_links: DataFrame | None = None
) -> DataFrame:
    """Rule on every proposed relationship from the statuses of its members.

    The statuses are those of ``findings``; without members and findings, the correlations were assessed with ``status_counts``.

    A contradiction is resolved when one side is verified and another rejected, and rejected when both are settled
    otherwise. Any other link needs two verified members and a lead that is not rejected; it waits while verified and
    pending members still make two.
    """
    df = correlations.where(F.col("status") == "proposed")
    if members is not None:
        current = members.select("repo_id", "signature", "finding_id", "is_lead").join(
            findings.select("repo_id", "finding_id", "status"), ["repo_id", "finding_id"]
        )
        df = df.join(current.groupBy("repo_id", "signature").agg(*status_counts()), ["repo_id", "signature"])
    if broken_links is not None:
        df = df.join(broken_links.withColumn("_broken", F.lit(True)), ["repo_id", "signature"], "left")
    else:
        df = df.withColumn("_broken", F.lit(False))
    contradiction = F.col("relationship_type") == "contradiction"
    decision = (
        F.when(
            contradiction,
            F.when((F.col("verified") > 0) & (F.col("rejected") > 0), F.lit("verified")).otherwise(
                F.lit("needs_more_evidence")
            ),
        )
        .when((F.col("verified") >= 2) & (F.col("lead_status") != "rejected"), F.lit("verified"))
        .when((F.col("pending") > 0) & (F.col("verified") + F.col("pending") >= 2), F.lit("needs_more_evidence"))
        .otherwise(F.lit("rejected"))
    )
    status = (
        F.when(contradiction & (F.col("decision") == "verified"), F.lit("resolved"))
        .when(contradiction & (F.col("pending") == 0), F.lit("rejected"))
        .when(F.col("decision") == "needs_more_evidence", F.lit("proposed"))
        .otherwise(F.col("decision"))
    )
    lowered = (
        (F.col("relationship_type") == "compound_risk")
        & (F.col("decision") == "verified")
        & F.coalesce(F.col("_broken"), F.lit(False))
    )
    return (
        df.withColumn("decision", decision)
        .withColumn("status", status)
        .withColumn(
            "risk_multiplier",
            F.when(lowered, stable_round(F.greatest(F.lit(1.0), F.col("risk_multiplier") - 0.25), 2)).otherwise(
                F.col("risk_multiplier")
            ),
        )
        .drop("_broken")
    )


def remaining_members(ruled: DataFrame, members: DataFrame, findings: DataFrame) -> DataFrame:
    """Members of ruled relationships; verified ones lose their rejected members."""
    kinds = ruled.select("repo_id", "signature", "decision", "relationship_type")
    joined = (
        members.drop("status", "relationship_type")
        .join(findings.select("repo_id", "finding_id", "status"), ["repo_id", "finding_id"])
        .join(kinds, ["repo_id", "signature"])
    )
    drop = (F.col("decision") == "verified") & (F.col("status") == "rejected") & (F.col("relationship_type") != "contradiction")
    return joined.where(~drop).drop("decision")

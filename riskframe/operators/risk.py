"""Risk scoring: severity x confidence x impact x exploitability x correlation multiplier, saturated to 0-100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import lookup, severity_rank, stable_round
from riskframe.operators.correlate import duplicate_links

MULTIPLYING = ("causal", "dependency")


def impact(files: str = "affected_files", components: str = "affected_components") -> Column:
    """Supplied value, else critical component, license, test-only code, package or code, anything else."""
    critical = F.arrays_overlap(F.col(components), F.array(*[F.lit(c) for c in C.CRITICAL_COMPONENTS]))
    in_tests = F.forall(
        F.col(files),
        lambda f: F.coalesce(F.col("test_only"), F.lit(False)) | F.contains(F.concat(F.lit("/"), f), F.lit("/tests/")),
    )
    return (
        F.when(F.col("impact").isNotNull(), F.col("impact"))
        .when(F.coalesce(critical, F.lit(False)), F.lit(1.0))
        .when(F.col("category") == "license", F.lit(0.6))
        .when((F.size(F.col(files)) > 0) & in_tests, F.lit(0.3))
        .when(F.col("category").isin("dependency", "security"), F.lit(0.8))
        .otherwise(F.lit(0.7))
    )


def exploitability() -> Column:
    reach = F.col("reachability")
    return (
        F.when(F.col("likelihood").isNotNull(), F.col("likelihood"))
        .when(
            F.col("category").isin("security", "dependency"),
            F.when(reach == "entrypoint", 0.8).when(reach == "reachable", 0.65).when(reach == "unreachable", 0.25).otherwise(0.5),
        )
        .when(
            F.col("category") == "performance", F.when(F.col("measurement") == "measured", 0.6).otherwise(0.35)
        )
        .when(F.col("category") == "license", F.lit(0.6))
        .otherwise(F.lit(0.5))
    )


def severity_weight(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_WEIGHT, C.OTHER_SEVERITY_WEIGHT)


def normalise(raw: Column) -> Column:
    return stable_round(F.lit(100.0) * (1 - F.exp(-F.lit(C.RISK_SATURATION) * F.greatest(F.lit(0.0), raw))), 1)


def priority(score: Column) -> Column:
    out = None
    for cut, name, _level in C.SCORE_CUTS:
        out = F.when(score >= cut, F.lit(name)) if out is None else out.when(score >= cut, F.lit(name))
    return out.otherwise(F.lit(C.LOWEST_PRIORITY))


def risk_level(score: Column) -> Column:
    out = None
    for cut, _name, level in C.SCORE_CUTS:
        out = F.when(score >= cut, F.lit(level)) if out is None else out.when(score >= cut, F.lit(level))
    return out.otherwise(F.lit(C.LOWEST_LEVEL))


def with_score(df: DataFrame) -> DataFrame:
    """Add ``raw``, ``score`` and ``priority`` from severity, confidence, impact, exploitability and multiplier."""
    raw = (
        severity_weight(F.col("severity"))
        * F.col("confidence")
        * F.col("impact_value")
        * F.col("exploitability_value")
        * F.col("multiplier")
    )
    return (
        df.withColumn("_raw", raw)
        .withColumn("raw", stable_round(F.col("_raw"), 4))
        .withColumn("score", normalise(F.col("_raw")))
        .drop("_raw")
        .withColumn("priority", priority(F.col("score")))
    )


def duplicates_of_verified(findings: DataFrame) -> DataFrame:
    """Verified findings that repeat an earlier verified one of another agent.

    They are looked for among the verified findings, not among the links proposed before verification: the earliest
    report of a place may have been refused since, and two later ones verified.
    """
    return duplicate_links(findings.where(F.col("status") == "verified")).select("repo_id", "finding_id").distinct()


def finding_risks(findings: DataFrame, correlations: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """One risk per verified, non-info finding that doesn't repeat an earlier verified one.

    Only causal and dependency links multiply a single finding; compound risks get their own row.
    """
    scored = (
        findings.where((F.col("status") == "verified") & (F.col("severity") != "info"))
        .withColumn("impact_value", impact())
        .withColumn("exploitability_value", exploitability())
        .join(duplicates_of_verified(findings), ["repo_id", "finding_id"], "left_anti")
    )
    if correlations is None:
        return with_score(scored.withColumn("multiplier", F.lit(1.0)).withColumn("via", F.lit(None).cast("string")))
    links = correlations.where((F.col("status") == "verified") & F.col("relationship_type").isin(*MULTIPLYING))
    best = (
        members.select("repo_id", "signature", "finding_id")
        .join(links.select("repo_id", "signature", "risk_multiplier"), ["repo_id", "signature"])
        .where(F.col("risk_multiplier") > 1.0)
        .groupBy("repo_id", "finding_id")
        .agg(
            F.max("risk_multiplier").alias("multiplier"),
            F.min_by("signature", F.struct(-F.col("risk_multiplier"), F.col("signature"))).alias("via"),
        )
    )
    return with_score(
        scored.join(best, ["repo_id", "finding_id"], "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))
    )


def excluded_findings(findings: DataFrame) -> DataFrame:
    """Findings that get no risk, with the reason."""
    duplicate = duplicates_of_verified(findings).withColumn("_duplicate", F.lit(True))
    reason = (
        F.when(F.col("status") == "rejected", F.lit("rejected by verification"))
        .when(F.col("status") != "verified", F.lit("insufficient evidence (not verified)"))
        .when(F.col("_duplicate"), F.lit("duplicate of another verified finding"))
    )
    return (
        findings.where(F.col("severity") != "info")
        .join(duplicate, ["repo_id", "finding_id"], "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("repo_id", "finding_id", "status", "reason")
    )


def compound_risks(findings: DataFrame, correlations: DataFrame, members: DataFrame) -> DataFrame:
    """One risk per verified compound or causal link with two verified members: the worst of each factor."""
    links = correlations.where((F.col("status") == "verified") & F.col("relationship_type").isin("compound_risk", "causal"))
    verified = (
        findings.where(F.col("status") == "verified")
        .withColumn("impact_value", impact())
        .withColumn("exploitability_value", exploitability())
        .select("repo_id", "finding_id", "severity", "category", "title", "impact_value", "exploitability_value")
    )
    worst = (
        members.select("repo_id", "signature", "finding_id")
        .join(verified, ["repo_id", "finding_id"])
        .groupBy("repo_id", "signature")
        .agg(
            F.count("*").alias("verified_members"),
            F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
            F.max("impact_value").alias("impact_value"),
            F.max("exploitability_value").alias("exploitability_value"),
            F.size(F.collect_set("category")).alias("dimensions"),
        )
        .where(F.col("verified_members") >= 2)
    )
    joined = links.select(
        "repo_id", "signature", "relationship_type", "confidence", F.col("risk_multiplier").alias("multiplier")
    ).join(worst, ["repo_id", "signature"])
    return with_score(joined)


def overall_risk(risks: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """The worst risk dominates; each of the next nine counts with half the weight of the one before."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc()))
    top = risks.select(*keys, "score").withColumn("_rank", rank).where(F.col("_rank") <= C.RISKS_IN_OVERALL)
    return (
        top.groupBy(*keys)
        .agg(F.product(1 - F.col("score") / 100.0 * F.pow(F.lit(0.5), F.col("_rank") - 1)).alias("_remaining"))
        .withColumn("overall_score", stable_round(F.lit(100.0) * (1 - F.col("_remaining")), 1))
        .withColumn("level", risk_level(F.col("overall_score")))
        .drop("_remaining")
    )

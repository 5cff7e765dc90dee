"""Confidence of findings, computed from their evidence and context (never asked for)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import lookup, stable_round

CONTEXT = {
    "reproduced": "boolean",
    "reachable": "boolean",
    "corroborating_agents": "int",
    "contradictions": "int",
    "verification": "string",
    "static_suspect": "boolean",
    "is_hypothesis": "boolean",
}


def evidence_strength(evidence: DataFrame, key: str = "finding_id") -> DataFrame:
    """Noisy-or strength per finding. The product combines map-side, so a finding with much evidence stays cheap."""
    weight = lookup(F.col("source_type"), C.SOURCE_WEIGHT, C.OTHER_SOURCE_WEIGHT)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return (
        evidence.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.product(1 - weight * clamped).alias("_miss"),
            F.count("*").alias("evidence_count"),
            F.sort_array(F.collect_set("source_type")).alias("source_types"),
        )
        .select(
            key,
            F.least(F.lit(C.MAX_STRENGTH), 1 - F.col("_miss")).alias("strength"),
            "evidence_count",
            "source_types",
        )
    )


def _factor(name: str, delta: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("factor"), stable_round(delta, 3).alias("delta"), detail.alias("detail"))


def score_confidence(findings: DataFrame, strength: DataFrame, key: str = "finding_id") -> DataFrame:
    """Add ``confidence`` and ``confidence_factors``. Context columns that are missing count as unknown."""
    df = findings.drop("confidence", "confidence_factors").join(strength, key, "left")
    for name, kind in CONTEXT.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    count = F.coalesce(F.col("evidence_count"), F.lit(0))
    base = F.when(count > 0, F.col("strength")).otherwise(F.lit(C.NO_EVIDENCE_STRENGTH))
    agents = F.coalesce(F.col("corroborating_agents"), F.lit(0))
    against = F.coalesce(F.col("contradictions"), F.lit(0))
    adjustments = [
        ("reproduction", F.col("reproduced"), F.lit(0.10), F.lit("claim reproduced by tests or a benchmark")),
        ("reachability", F.col("reachable"), F.lit(0.05), F.lit("affected code is reachable from non-test code")),
        ("reachability", ~F.col("reachable"), F.lit(-0.25), F.lit("affected code is not reachable from production code")),
        (
            "corroboration",
            agents > 0,
            F.least(F.lit(0.15), F.lit(0.05) * agents),
            F.concat(agents.cast("string"), F.lit(" other agent(s) produced related evidence")),
        ),
        ("static_suspect", F.col("static_suspect"), F.lit(-0.10), F.lit("performance claim not yet measured")),
        (
            "contradiction",
            against > 0,
            -F.least(F.lit(0.30), F.lit(0.15) * against),
            F.concat(against.cast("string"), F.lit(" contradicting finding(s)")),
        ),
        ("verification", F.col("verification") == "verified", F.lit(0.10), F.lit("survived verification")),
        (
            "verification",
            F.col("verification") == "needs_more_evidence",
            F.lit(-0.10),
            F.lit("verification asked for more evidence"),
        ),
    ]
    raw = base
    for _name, applies, delta, _detail in adjustments:
        raw = raw + F.when(F.coalesce(applies, F.lit(False)), delta).otherwise(F.lit(0.0))
    df = df.withColumn("_raw", raw)
    hypothesis = F.coalesce(F.col("is_hypothesis"), F.lit(False))
    rejected = F.coalesce(F.col("verification") == "rejected", F.lit(False))
    df = df.withColumn("_capped", F.when(hypothesis, F.least(F.col("_raw"), F.lit(0.40))).otherwise(F.col("_raw")))
    final = F.when(rejected, F.least(F.col("_capped"), F.lit(0.10))).otherwise(F.col("_capped"))
    strength_detail = F.when(
        count > 0,
        F.concat(count.cast("string"), F.lit(" evidence item(s): "), F.array_join("source_types", ", ")),
    ).otherwise(F.lit("no supporting evidence"))
    factors = F.array_compact(
        F.array(
            _factor("evidence_strength", base, strength_detail),
            *[F.when(F.coalesce(on, F.lit(False)), _factor(n, d, t)) for n, on, d, t in adjustments],
            F.when(
                hypothesis & (F.col("_raw") > 0.40),
                _factor("hypothesis_cap", F.lit(0.40) - F.col("_raw"), F.lit("hypotheses are capped at 0.40")),
            ),
            F.when(
                rejected & (F.col("_capped") > 0.10),
                _factor("rejected_cap", F.lit(0.10) - F.col("_capped"), F.lit("rejected; capped at 0.10")),
            ),
        )
    )
    return (
        df.withColumn("confidence_factors", factors)
        .withColumn("confidence", stable_round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), final)), 3))
        .drop("_raw", "_capped")
    )


def with_confidence(findings: DataFrame, evidence: DataFrame, key: str = "finding_id") -> DataFrame:
    return score_confidence(findings, evidence_strength(evidence, key), key)


def context_from_findings(findings: DataFrame) -> DataFrame:
    """Fill the context columns that a finding's own status and reachability already settle."""
    return findings.withColumn(
        "reachable",
        F.when(F.col("reachability").isin("entrypoint", "reachable"), F.lit(True)).when(
            F.col("reachability") == "unreachable", F.lit(False)
        ),
    ).withColumn(
        "verification",
        F.when(F.col("status").isin("verified", "rejected", "needs_more_evidence"), F.col("status")),
    )

"""Recommendations from risks: compounds first, then findings that no compound covers; action proposals for the worst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import literal_table, lookup

RECOMMENDED = ("P0", "P1", "P2", "P3")

# ---- templates: rule, why, fix, benefit, difficulty (our wording; extend the table for more rules) -------------
TEMPLATES = [
    ("security.jwt_no_algorithms", "The library may accept an algorithm the server never meant to.", "Pass an explicit algorithms list to every decode call and test that others are refused.", "Closes algorithm confusion.", "low"),
    ("security.hardcoded_default_secret", "Without the variable, tokens are signed with a public literal.", "Remove the literal and fail at start-up when the secret is missing.", "No silent insecure deployment.", "low"),
    ("security.weak_password_hash", "Fast unsalted hashes are cracked quickly once they leak.", "Use argon2id or bcrypt and hash again on the next login.", "Leaked hashes stay useless.", "medium"),
    ("security.prompt_injection_content", "Assistants that read the repository may follow the embedded text.", "Remove instructions addressed to machines; treat repository text as data.", "Less manipulation of tooling.", "low"),
    ("testing.test_failure", "A red test is a defect or a suite nobody trusts.", "Fix the code under test, or the expectation, and keep the test in CI.", "A suite that means something.", "low"),
    ("testing.untested_critical_path", "Critical code changes ship without a regression signal.", "Add unit tests for the component's good and bad paths.", "Fixes and upgrades become safe.", "medium"),
    ("performance.n_plus_one", "Query count grows with the number of rows.", "Load the related rows in one query and group them in memory.", "A constant number of queries.", "low"),
    ("performance.network_in_loop", "One blocking call per item makes latency grow with the input.", "Use a bulk endpoint or a bounded pool with a shared session.", "Latency independent of the item count.", "medium"),
    ("license.metadata_mismatch", "Contradictory terms leave every user in doubt.", "Decide on one license and state it in both places.", "Clear licensing.", "low"),
    ("license.copyleft_file", "Copyleft code changes the terms of the combined work.", "Replace the code or obtain it under a compatible license.", "No copyleft obligations.", "low"),
    ("code_quality.high_complexity", "Complex functions hide defects and resist review.", "Split filtering and formatting into small tested functions.", "Easier review and safer change.", "medium"),
]


def template_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TEMPLATES, "rule_id string, why string, fix string, benefit string, difficulty string")


def compound_recommendations(compounds: DataFrame, members: DataFrame, findings: DataFrame, templates: DataFrame) -> DataFrame:
    """One recommendation per compound with its steps: upgrade, call sites, tests, then other fixes."""
    keys = ["repo_id", "signature"]
    chosen = compounds.where(F.col("priority").isin(*RECOMMENDED))
    parts = (
        members.select(*keys, "finding_id")
        .join(chosen.select(*keys), keys, "left_semi")
        .join(
            findings.where(F.col("status") == "verified").select(
                "repo_id", "finding_id", "rule_id", "category", "title", "vulnerable", "package", "version", "created_at"
            ),
            ["repo_id", "finding_id"],
        )
        .join(templates.select("rule_id", "fix"), "rule_id", "left")
    )
    upgrade = (F.col("category") == "dependency") & F.coalesce(F.col("vulnerable"), F.lit(False))
    api = F.col("rule_id") == "api.upgrade_breaking_changes"
    tests = F.col("category") == "testing"
    kind = F.when(upgrade, 1).when(api, 2).when(tests, 3).when(F.col("fix").isNotNull(), 4)
    text = (
        F.when(upgrade, F.concat(F.lit("Upgrade "), "package", F.lit(" from "), "version", F.lit(" to a fixed release.")))
        .when(api, F.lit("In the same change, update the call sites the upgrade breaks."))
        .when(tests, F.concat(F.lit("Add regression tests first: "), "title", F.lit(".")))
        .otherwise(F.concat_ws(": ", "title", "fix"))
    )
    order = Window.partitionBy(*keys, "_kind").orderBy("created_at", "finding_id")
    steps = (
        parts.withColumns({"_kind": kind, "_text": text})
        .where(F.col("_kind").isNotNull())
        .withColumn("_n", F.row_number().over(order))
        .where((F.col("_kind") > 2) | (F.col("_n") == 1))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("_kind", "_n", "_text"))).alias("_steps"),
            F.max(F.col("_kind").isin(2, 3)).alias("_harder"),
        )
    )
    numbered = F.transform(F.col("_steps"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["_text"]))
    return chosen.join(steps, keys, "left").select(
        "repo_id",
        F.lit("compound").alias("kind"),
        F.col("signature").alias("risk_key"),
        "priority",
        "score",
        F.concat(F.lit("Fix compound risk: "), "signature").alias("title"),
        F.coalesce(F.array_join(numbered, "\n"), F.lit("Review and remediate.")).alias("fix"),
        F.when(F.coalesce("_harder", F.lit(False)), "medium").otherwise("low").alias("difficulty"),
    )


def finding_recommendations(risks: DataFrame, covered: DataFrame, templates: DataFrame) -> DataFrame:
    """One recommendation per finding risk that no recommended compound covers, from the rule's template."""
    return (
        risks.where(F.col("priority").isin(*RECOMMENDED))
        .join(covered, ["repo_id", "finding_id"], "left_anti")
        .join(templates, "rule_id", "left")
        .select(
            "repo_id",
            F.lit("finding").alias("kind"),
            F.col("finding_id").cast("string").alias("risk_key"),
            "priority",
            "score",
            "title",
            F.coalesce("fix", F.lit("Review and remediate.")).alias("fix"),
            F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        )
    )


def recommendations(
    finding_risks: DataFrame, compounds: DataFrame, members: DataFrame, findings: DataFrame, templates: DataFrame | None = None
) -> DataFrame:
    """All recommendations. Verified members of a recommended compound are not repeated on their own."""
    table = templates if templates is not None else template_table(findings.sparkSession)
    chosen = compounds.where(F.col("priority").isin(*RECOMMENDED))
    verified = findings.where(F.col("status") == "verified").select("repo_id", "finding_id")
    covered = (
        members.select("repo_id", "signature", "finding_id")
        .join(chosen.select("repo_id", "signature"), ["repo_id", "signature"], "left_semi")
        .join(verified, ["repo_id", "finding_id"], "left_semi")
        .select("repo_id", "finding_id")
        .distinct()
    )
    return compound_recommendations(compounds, members, findings, table).unionByName(
        finding_recommendations(finding_risks, covered, table)
    )


def action_proposals(recommended: DataFrame) -> DataFrame:
    """Issue proposals for the two highest priorities; each waits for approval."""
    return recommended.where(F.col("priority").isin("P0", "P1")).select(
        "repo_id",
        "risk_key",
        F.lit("issue").alias("action_type"),
        F.concat(F.lit("["), "priority", F.lit("] "), "title").alias("title"),
        F.lit("proposed").alias("status"),
        F.lit(True).alias("requires_approval"),
        F.col("score").alias("risk_score"),
    )


def ordered(recommended: DataFrame) -> DataFrame:
    return recommended.orderBy("repo_id", lookup(F.col("priority"), C.PRIORITY_RANK, 9), F.col("score").desc(), "risk_key")

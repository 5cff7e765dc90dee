"""Planning as table work: which specialists a repository needs, which requests are granted, what happens next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import constants as C

QUICK = ("security_agent", "dependency_agent", "test_reliability_agent")
PRIORITY_OF_AGENT = {
    "security_agent": 1,
    "dependency_agent": 1,
    "test_reliability_agent": 2,
    "api_compatibility_agent": 2,
    "performance_agent": 2,
    "code_quality_agent": 3,
    "license_agent": 3,
    "maintenance_agent": 3,
}


def plan(profiles: DataFrame) -> DataFrame:
    """One row per repository and specialist: selected or skipped, with priority and reason.

    Reads ``source_file_count, ecosystems, python_packages, git_commits, uses_database, uses_network_calls, depth``.
    """
    c = F.col
    has_source, deep = c("source_file_count") > 0, c("depth") == "deep"
    wanted: dict[str, Column] = {
        "security_agent": has_source,
        "dependency_agent": F.size("ecosystems") > 0,
        "test_reliability_agent": has_source,
        "code_quality_agent": has_source,
        "api_compatibility_agent": (F.size("python_packages") > 0) | F.array_contains("ecosystems", "npm") | deep,
        "license_agent": F.lit(True),
        "maintenance_agent": c("git_commits") > 0,
        "performance_agent": c("uses_database") | c("uses_network_calls") | deep,
    }
    quick = c("depth") == "quick"
    rows = F.array(
        *[
            F.struct(
                F.lit(agent).alias("agent"),
                F.lit(PRIORITY_OF_AGENT[agent]).alias("priority"),
                (rule & (~quick | F.lit(agent in QUICK))).alias("selected"),
                F.when(~rule, F.lit("nothing to look at")).when(quick & F.lit(agent not in QUICK), F.lit("quick depth")).alias("reason"),
            )
            for agent, rule in wanted.items()
        ]
    )
    return profiles.select("repo_id", F.inline(rows))


def follow_ups(requests: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Tasks each request asks for, without unavailable agents.

    ``requests(repo_id, request_id, required_evidence, package, current_version, target_version, target_agent)``.
    """
    c = F.col
    evidence, has_package = c("required_evidence"), c("package").isNotNull()
    impact = (evidence == "impact_analysis") & has_package
    task = lambda on, agent, mode: F.when(on, F.struct(F.lit(agent).alias("agent"), F.lit(mode).alias("mode")))
    known = impact | (evidence == "benchmark") | (evidence.isin("usage_analysis", "upgrade_compatibility", "test_coverage") & has_package)
    rows = F.array_compact(
        F.array(
            task(impact | ((evidence == "usage_analysis") & has_package), "security_agent", "dependency_usage"),
            task(
                (impact & c("target_version").isNotNull()) | ((evidence == "upgrade_compatibility") & has_package),
                "api_compatibility_agent",
                "upgrade_compatibility",
            ),
            task(impact | ((evidence == "test_coverage") & has_package), "test_reliability_agent", "dependency_coverage"),
            task(impact & F.lower("package").isin(*C.PERFORMANCE_PACKAGES), "performance_agent", "full"),
            task(evidence == "benchmark", "performance_agent", "benchmark"),
            F.when(
                ~known & c("target_agent").isin(*C.SPECIALISTS), F.struct(c("target_agent").alias("agent"), F.lit("full").alias("mode"))
            ),
        )
    )
    focus = F.concat_ws("|", "package", "current_version", "target_version")
    return (
        requests.withColumn("_t", F.explode(rows))
        .select("repo_id", "request_id", "_t.agent", "_t.mode", focus.alias("focus"))
        .join(unavailable.select("repo_id", "agent"), ["repo_id", "agent"], "left_anti")
        .withColumn("task_key", F.sha2(F.concat_ws("|", "agent", "mode", "focus"), 256))
    )


def decide_requests(requests: DataFrame, planned: DataFrame, completed: DataFrame, budget_left: bool = True) -> DataFrame:
    """Accept or decline each request; work that was done before is not done again. ``completed(repo_id, task_key)``."""
    fresh = planned.join(completed, ["repo_id", "task_key"], "left_anti")
    counts = planned.groupBy("repo_id", "request_id").agg(F.count("*").alias("_planned"))
    fresh_counts = fresh.groupBy("repo_id", "request_id").agg(F.count("*").alias("_fresh"))
    reason = (
        F.when(~F.lit(budget_left), F.lit("budget exhausted"))
        .when(F.col("_planned").isNull(), F.lit("no specialist can provide it"))
        .when(F.col("_fresh").isNull(), F.lit("already performed"))
        .otherwise(F.lit("assigned"))
    )
    return (
        requests.select("repo_id", "request_id")
        .join(counts, ["repo_id", "request_id"], "left")
        .join(fresh_counts, ["repo_id", "request_id"], "left")
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason") == "assigned")
        .drop("_planned", "_fresh")
    )


def distinct_tasks(planned: DataFrame, completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks without twins, and which request each task serves; twins share one task."""
    fresh = planned.join(completed, ["repo_id", "task_key"], "left_anti")
    tasks = fresh.dropDuplicates(["repo_id", "task_key"]).drop("request_id")
    return tasks, fresh.where(F.col("request_id").isNotNull()).select("repo_id", "request_id", "task_key").distinct()


def fulfilled_requests(assignments: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests all of whose tasks completed; ``runs(repo_id, task_key, status)``."""
    done = runs.where(F.col("status") == "completed").select("repo_id", "task_key").distinct().withColumn("_done", F.lit(1))
    return (
        assignments.join(done, ["repo_id", "task_key"], "left")
        .groupBy("repo_id", "request_id")
        .agg(F.min(F.coalesce("_done", F.lit(0))).alias("_all"))
        .where(F.col("_all") == 1)
        .drop("_all")
    )


def retries(failed: DataFrame, max_retries: int, final_errors: tuple[str, ...] = ()) -> DataFrame:
    """Retry decision per failed run; a performance run without its tool goes on without measuring."""
    retry = F.col("retryable") & (F.col("attempt") <= max_retries) & ~F.coalesce(F.col("error_type").isin(*final_errors), F.lit(False))
    lighter = (F.col("agent") == "performance_agent") & (F.col("error_type") == "ToolUnavailableError")
    strategy = F.when(lighter, F.lit("static_only")).otherwise(F.col("strategy"))
    return failed.withColumns({"retry": retry, "next_strategy": F.when(retry, strategy), "next_attempt": F.when(retry, F.col("attempt") + 1)})


def escalations(findings: DataFrame, escalated: DataFrame) -> DataFrame:
    """Severe vulnerable packages nobody asked about yet: one impact request per package."""
    return (
        findings.where((F.col("rule_id") == "dependency.vulnerable") & F.col("severity").isin("critical", "high"))
        .join(escalated.select("repo_id", "package"), ["repo_id", "package"], "left_anti")
        .groupBy("repo_id", "package")
        .agg(F.min(F.struct("created_at", "finding_id")).alias("_f"))
        .select("repo_id", "package", F.col("_f.finding_id").alias("finding_id"), F.lit("impact_analysis").alias("required_evidence"))
    )


def next_phase(cases: DataFrame, max_correlations: int = 3, max_verifications: int = 2) -> DataFrame:
    """Dispatch, correlate, verify or assess, from the counters of each case.

    Reads ``cancelled, retries, follow_ups, version, correlated_version, correlation_rounds, pending, verification_rounds``.
    """
    c = F.col
    step = (
        F.when(c("cancelled"), F.lit("finalize"))
        .when((c("retries") > 0) | (c("follow_ups") > 0), F.lit("dispatch"))
        .when((c("version") > c("correlated_version")) & (c("correlation_rounds") < max_correlations), F.lit("correlate"))
        .when((c("pending") > 0) & (c("verification_rounds") < max_verifications), F.lit("verify"))
        .otherwise(F.lit("assess"))
    )
    return cases.withColumn("next_step", step)

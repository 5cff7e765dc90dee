"""Commit, pull-request, release and run activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.versions import age_days

MIN_COMMITS = 5


def commit_activity(commits: DataFrame, now: Column) -> DataFrame:
    """Per repository: age of the newest commit, commits of the last year, contributors and the top author's share.

    Authors are counted first, so that a large repository reaches the second step as one row per author. Authors of the
    last year count; those of all time only when nobody committed in the last year.
    """
    recent = F.col("date") > now - F.expr("INTERVAL 365 DAYS")
    authors = commits.groupBy("repo_id", "author").agg(
        F.count("*").alias("_all"), F.count_if(recent).alias("_recent"), F.max("date").alias("_newest")
    )
    year = F.sum("_recent")
    return (
        authors.groupBy("repo_id")
        .agg(
            F.sum("_all").alias("commits"),
            year.alias("commits_last_year"),
            F.max("_newest").alias("newest"),
            F.count_if(F.col("_recent") > 0).alias("_authors_recent"),
            F.count("*").alias("_authors_all"),
            F.max("_recent").alias("_top_recent"),
            F.max("_all").alias("_top_all"),
        )
        .withColumn("last_commit_days", age_days(F.col("newest"), now))
        .withColumn(
            "contributors", F.when(F.col("commits_last_year") > 0, F.col("_authors_recent")).otherwise(F.col("_authors_all"))
        )
        .withColumn(
            "window_commits", F.when(F.col("commits_last_year") > 0, F.col("commits_last_year")).otherwise(F.col("commits"))
        )
        .withColumn(
            "top_author_commits", F.when(F.col("commits_last_year") > 0, F.col("_top_recent")).otherwise(F.col("_top_all"))
        )
        .withColumn("top_share", F.col("top_author_commits") / F.col("window_commits"))
        .where(F.col("commits") >= MIN_COMMITS)
        .drop("_authors_recent", "_authors_all", "_top_recent", "_top_all")
    )


def bus_factor(activity: DataFrame, min_commits: int = 20, share: float = 0.8) -> DataFrame:
    return activity.where((F.col("window_commits") >= min_commits) & (F.col("top_share") >= share))


def inactive(activity: DataFrame) -> DataFrame:
    """Repositories without a commit for a year; two years make it severe."""
    return activity.where(F.col("last_commit_days") > 365).withColumn(
        "severity", F.when(F.col("last_commit_days") > 730, F.lit("high")).otherwise(F.lit("medium"))
    )


def top_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("(root)"))


def stale_modules(
    touches: DataFrame, activity: DataFrame, now: Column, stale_days: int = 540, active_days: int = 90
) -> DataFrame:
    """Top-level folders nobody touched for a long time in repositories that are active.

    ``touches(repo_id, top_dir, date)`` is one row per touched folder and commit.
    """
    last = touches.groupBy("repo_id", "top_dir").agg(F.max("date").alias("last_touch"))
    active = activity.where(F.col("last_commit_days") < active_days).select("repo_id")
    return (
        last.join(active, "repo_id", "left_semi")
        .withColumn("untouched_days", age_days(F.col("last_touch"), now))
        .where((F.col("untouched_days") > stale_days) & (F.col("top_dir") != "(root)"))
    )


def pull_request_states(pulls: DataFrame, now: Column, stale_days: int = 180, min_stale: int = 5) -> DataFrame:
    """Merged, open and closed pull requests per repository, and whether too many open ones went quiet."""
    state = F.when(F.col("merged_at").isNotNull(), F.lit("merged")).otherwise(F.coalesce("state", F.lit("unknown")))
    stale = (F.col("state") == "open") & (age_days(F.col("updated_at"), now) > stale_days)
    return (
        pulls.groupBy("repo_id")
        .agg(
            F.count_if(state == "merged").alias("merged"),
            F.count_if(state == "open").alias("open"),
            F.count_if(state == "closed").alias("closed"),
            F.count_if(stale).alias("stale_open"),
        )
        .withColumn("stale_pull_requests", F.col("stale_open") >= min_stale)
    )


def release_gap(releases: DataFrame, activity: DataFrame, now: Column) -> DataFrame:
    """Repositories with recent commits whose last release is more than two years old."""
    latest = releases.groupBy("repo_id").agg(F.max("published_at").alias("latest_release"))
    return (
        latest.withColumn("last_release_days", age_days(F.col("latest_release"), now))
        .where(F.col("last_release_days") > 730)
        .join(activity.where(F.col("last_commit_days") < 180).select("repo_id", "last_commit_days"), "repo_id")
    )


def maintenance_findings(
    activity: DataFrame, stale: DataFrame, archived: DataFrame, no_release: DataFrame, pulls: DataFrame
) -> DataFrame:
    """All maintenance rules as findings: ``repo_id, rule_id, severity, subject``."""

    def rows(df: DataFrame, rule: str, severity: Column | str, subject: str) -> DataFrame:
        value = severity if isinstance(severity, Column) else F.lit(severity)
        return df.select(
            "repo_id",
            F.lit(f"maintenance.{rule}").alias("rule_id"),
            value.alias("severity"),
            F.lit(f"maintenance:{subject}").alias("subject"),
        ).distinct()

    return (
        rows(inactive(activity), "inactive", F.col("severity"), "activity")
        .unionByName(rows(bus_factor(activity), "bus_factor", "medium", "contributors"))
        .unionByName(rows(stale, "stale_module", "low", "stale_modules"))
        .unionByName(rows(archived.where("archived"), "archived", "high", "activity"))
        .unionByName(rows(no_release, "no_recent_release", "low", "releases"))
        .unionByName(rows(pulls.where("stale_pull_requests"), "stale_pull_requests", "low", "pulls"))
    )


# -------------------------------------------------------------------------------------------- runs
def failed_run() -> Column:
    return F.col("status").isin("failed", "timeout")


def agent_summary(runs: DataFrame, keys: tuple[str, ...] = ("repo_id", "agent")) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"),
        F.count_if(failed_run()).alias("failures"),
        F.count_if(F.col("trigger") == "retry").alias("retries"),
        F.sum("findings_count").cast("bigint").alias("findings"),
        F.sum("tool_calls").cast("bigint").alias("tool_calls"),
        F.sum("duration_s").cast("bigint").alias("duration_s"),
    )


def coverage(runs: DataFrame) -> DataFrame:
    """Coverage of every specialist in every case: skipped, unavailable, partial or complete.

    A limitation makes coverage partial; runs without a ``limitations`` column have none.
    """
    limited = F.size("limitations") > 0 if "limitations" in runs.columns else F.lit(False)
    done = F.col("status") == "completed"
    per_agent = runs.where(F.col("agent").isin(*C.SPECIALISTS)).groupBy("repo_id", "agent").agg(
        F.count("*").alias("runs"),
        F.count_if(done).alias("_completed"),
        F.count_if(failed_run()).alias("failures"),
        F.max((limited | (done & (F.col("strategy") == "static_only"))).cast("int")).alias("_limited"),
    )
    expected = runs.select("repo_id").distinct().select(
        "repo_id", F.explode(F.array(*[F.lit(a) for a in C.SPECIALISTS])).alias("agent")
    )
    status = (
        F.when(F.col("runs").isNull(), F.lit("skipped"))
        .when(F.col("_completed") == 0, F.lit("unavailable"))
        .when((F.col("failures") > 0) | (F.col("_limited") > 0), F.lit("partial"))
        .otherwise(F.lit("complete"))
    )
    return expected.join(per_agent, ["repo_id", "agent"], "left").select(
        "repo_id",
        "agent",
        status.alias("coverage"),
        F.coalesce("runs", F.lit(0)).alias("runs"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
    )


def limitation_list(runs: DataFrame) -> DataFrame:
    """Distinct limitations per agent; failed attempts say so themselves."""
    failure = F.when(
        failed_run(),
        F.array(F.format_string("attempt %d (%s/%s) %s", "attempt", "mode", "strategy", F.upper("status"))),
    ).otherwise(F.array().cast("array<string>"))
    every = F.concat(failure, F.coalesce("limitations", F.array().cast("array<string>")))
    return runs.select("repo_id", "agent", F.explode(every).alias("limitation")).distinct()


def case_status(runs: DataFrame, covered: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Final status and run counters per case. ``flags(repo_id, fatal, cancelled)`` mark cases that were stopped."""
    counters = runs.groupBy("repo_id").agg(
        F.count("*").alias("agent_runs"),
        F.count_if(failed_run()).alias("agent_failures"),
        F.count_if(F.col("trigger") == "retry").alias("retries"),
        F.count_if(F.col("trigger").isin("follow_up", "verification_request")).alias("follow_ups"),
        F.sum("tool_calls").cast("bigint").alias("tool_calls"),
        F.count_if(F.col("agent").isin(*C.COORDINATORS) & (F.col("status") != "completed")).alias("_coordination"),
    )
    weak = covered.groupBy("repo_id").agg(F.count_if(F.col("coverage").isin("partial", "unavailable")).alias("_weak"))
    df = counters.join(weak, "repo_id", "left")
    if flags is not None:
        df = df.join(flags, "repo_id", "left")
    else:
        df = df.withColumns({"fatal": F.lit(False), "cancelled": F.lit(False)})
    limited = (F.col("_weak") > 0) | (F.col("agent_failures") > 0) | (F.col("_coordination") > 0)
    status = (
        F.when(F.coalesce("fatal", F.lit(False)), F.lit("failed"))
        .when(F.coalesce("cancelled", F.lit(False)), F.lit("cancelled"))
        .when(limited, F.lit("completed_with_limitations"))
        .otherwise(F.lit("completed"))
    )
    return df.withColumn("status", status).drop("_weak", "_coordination", "fatal", "cancelled")


def unavailable_agents(runs: DataFrame, max_retries: int) -> DataFrame:
    """Agents that never completed and are out of retries."""
    return (
        runs.groupBy("repo_id", "agent")
        .agg(F.max((F.col("status") == "completed").cast("int")).alias("_done"), F.max("attempt").alias("attempts"))
        .where((F.col("_done") == 0) & (F.col("attempts") > max_retries))
        .drop("_done")
    )

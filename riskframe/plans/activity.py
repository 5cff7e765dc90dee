"""Queries on commits, runs and the execution trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import activity, sequence
from riskframe.plans.registry import query
from riskframe.sources.adapters import adapt

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def runs(spark, sf_dir) -> DataFrame:
    return adapt(spark, sf_dir, "runs").withColumn(
        "completed_at", F.timestamp_micros(F.unix_micros("started_at") + F.col("duration_s") * 1_000_000)
    )


RUNS_SQL = "timed AS (SELECT *, started_at + to_seconds(duration_s) AS completed_at FROM runs)"
ACTIVITY_SQL = f"""per_author AS (SELECT repo_id, author, count(*) AS n, count(*) FILTER (date > TIMESTAMP '{NOW}' - INTERVAL 365 DAY) AS r, max(date) AS newest
      FROM commits GROUP BY ALL),
    act AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS commits, CAST(sum(r) AS BIGINT) AS commits_last_year,
      CAST(floor(epoch_us(TIMESTAMP '{NOW}' - max(newest)) / 86400000000) AS BIGINT) AS last_commit_days,
      CASE WHEN sum(r) > 0 THEN count(*) FILTER (r > 0) ELSE count(*) END AS contributors,
      CASE WHEN sum(r) > 0 THEN max(r) ELSE max(n) END AS top_author_commits,
      CASE WHEN sum(r) > 0 THEN CAST(sum(r) AS BIGINT) ELSE CAST(sum(n) AS BIGINT) END AS window_commits
      FROM per_author GROUP BY repo_id HAVING sum(n) >= 5)"""


@query(
    "commit_activity",
    f"""WITH {ACTIVITY_SQL} SELECT *, round(top_author_commits / window_commits, 6) AS top_share FROM act""",
    uses=("commits",),
)
def commit_activity(spark, sf_dir):
    return (
        activity.commit_activity(adapt(spark, sf_dir, "commits"), now())
        .drop("newest")
        .withColumn("top_share", F.round("top_share", 6))
    )


@query(
    "bus_factor",
    f"""WITH {ACTIVITY_SQL} SELECT repo_id, window_commits, contributors FROM act WHERE window_commits >= 20 AND top_author_commits / window_commits >= 0.1""",
    uses=("commits",),
)
def bus_factor(spark, sf_dir):
    found = activity.bus_factor(activity.commit_activity(adapt(spark, sf_dir, "commits"), now()), share=0.1)
    return found.select("repo_id", "window_commits", "contributors")


@query(
    "stale_modules",
    f"""WITH {ACTIVITY_SQL}, last AS (SELECT repo_id, top_dir, max(date) AS t FROM commits GROUP BY ALL)
    SELECT repo_id, top_dir, CAST(floor(epoch_us(TIMESTAMP '{NOW}' - t) / 86400000000) AS BIGINT) AS untouched_days FROM last
    WHERE repo_id IN (SELECT repo_id FROM act WHERE last_commit_days < 90) AND untouched_days > 1""",
    uses=("commits",),
)
def stale_modules(spark, sf_dir):
    commits = adapt(spark, sf_dir, "commits")
    found = activity.stale_modules(commits, activity.commit_activity(commits, now()), now(), stale_days=1)
    return found.select("repo_id", "top_dir", "untouched_days")


@query(
    "event_sequence",
    "SELECT repo_id, event_id, row_number() OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS seq FROM trace",
    uses=("trace",),
)
def event_sequence(spark, sf_dir):
    return sequence.with_sequence(adapt(spark, sf_dir, "trace"), ["repo_id"], "ts", "event_id").select(
        "repo_id", "event_id", "seq"
    )


@query(
    "event_tail",
    """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS seq FROM trace)
    SELECT repo_id, event_id, seq, event_type FROM numbered WHERE seq > 20 AND seq <= 25""",
    uses=("trace",),
)
def event_tail(spark, sf_dir):
    from riskframe.operators.store import event_tail as tail

    numbered = sequence.with_sequence(adapt(spark, sf_dir, "trace"), ["repo_id"], "ts", "event_id")
    return tail(numbered, after_seq=20, limit=5).select("repo_id", "event_id", "seq", "event_type")


@query(
    "timeline_filter",
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS rn FROM trace
      WHERE event_type IN ('error', 'signup') AND (sender = 'license_agent' OR receiver = 'risk_agent') AND contains(lower(message || ' ' || event_type), 'k": 1'))
    SELECT repo_id, event_id, sender, receiver FROM ranked WHERE rn <= 12""",
    uses=("trace",),
)
def timeline_filter(spark, sf_dir):
    from riskframe.operators.store import timeline

    return timeline(
        adapt(spark, sf_dir, "trace"),
        groups={"Agent lifecycle": ("error", "signup")},
        group="Agent lifecycle",
        agent=None,
        text='K": 1',
        last=12,
        extra=(F.col("sender") == "license_agent") | (F.col("receiver") == "risk_agent"),
    ).select("repo_id", "event_id", "sender", "receiver")


@query(
    "peak_parallelism",
    f"""WITH {RUNS_SQL}, points AS (SELECT repo_id, started_at AS t, 1 AS d FROM timed UNION ALL SELECT repo_id, completed_at, -1 FROM timed),
    swept AS (SELECT repo_id, sum(d) OVER (PARTITION BY repo_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM points)
    SELECT repo_id, CAST(max(open) AS BIGINT) AS parallelism FROM swept GROUP BY repo_id""",
    uses=("runs",),
)
def peak_parallelism(spark, sf_dir):
    return sequence.peak_parallelism(runs(spark, sf_dir), ["repo_id"])


@query(
    "run_offsets",
    f"""WITH {RUNS_SQL}, ms AS (SELECT repo_id, run_id, epoch_us(started_at) AS s, epoch_us(completed_at) AS e FROM timed),
    spans AS (SELECT repo_id, min(s) AS t0, greatest(max(e), min(s) + 1000000) - min(s) AS span FROM ms GROUP BY repo_id)
    SELECT repo_id, run_id, round((s - t0) / span * 100, 6) AS left_percent, round(greatest(0.5, (e - s) / span * 100), 6) AS width_percent
    FROM ms JOIN spans USING (repo_id)""",
    uses=("runs",),
)
def run_offsets(spark, sf_dir):
    placed = sequence.run_offsets(runs(spark, sf_dir), ["repo_id"], now())
    return placed.select(
        "repo_id", "run_id", F.round("left_percent", 6).alias("left_percent"), F.round("width_percent", 6).alias("width_percent")
    )


@query("rate_limit_decisions")
def rate_limit_decisions(spark, sf_dir):
    hits = adapt(spark, sf_dir, "trace").select("repo_id", "event_id", "ts")
    return sequence.rate_limit_decisions(hits, "repo_id", "ts", "event_id", per_minute=3, window_seconds=21_600)


@query(
    "agent_summary",
    """SELECT repo_id, agent, count(*) AS runs, arg_max(status, (started_at, run_id)) AS last_status,
      count(*) FILTER (status IN ('failed', 'timeout')) AS failures, count(*) FILTER (trigger = 'retry') AS retries,
      CAST(sum(findings_count) AS BIGINT) AS findings, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(duration_s) AS BIGINT) AS duration_s
    FROM runs GROUP BY ALL""",
    uses=("runs",),
)
def agent_summary(spark, sf_dir):
    return activity.agent_summary(runs(spark, sf_dir))


COVERAGE_SQL = """agents AS (SELECT unnest(['security_agent','dependency_agent','code_quality_agent','api_compatibility_agent','test_reliability_agent','license_agent','maintenance_agent','performance_agent']) AS agent),
    per AS (SELECT repo_id, agent, count(*) AS runs, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS failures,
      count(*) FILTER (status = 'completed' AND strategy = 'static_only') AS limited FROM runs GROUP BY ALL),
    cov AS (SELECT r.repo_id, a.agent, CASE WHEN p.runs IS NULL THEN 'skipped' WHEN done = 0 THEN 'unavailable' WHEN failures > 0 OR limited > 0 THEN 'partial' ELSE 'complete' END AS coverage,
      coalesce(p.runs, 0) AS runs, coalesce(failures, 0) AS failures
    FROM (SELECT DISTINCT repo_id FROM runs) r CROSS JOIN agents a LEFT JOIN per p ON p.repo_id = r.repo_id AND p.agent = a.agent)"""


@query("coverage_status", f"WITH {COVERAGE_SQL} SELECT * FROM cov", uses=("runs",))
def coverage_status(spark, sf_dir):
    return activity.coverage(runs(spark, sf_dir))


@query(
    "case_status",
    f"""WITH {COVERAGE_SQL}, c AS (SELECT repo_id, count(*) AS agent_runs, count(*) FILTER (status = 'failed') AS agent_failures,
      count(*) FILTER (trigger = 'retry') AS retries, count(*) FILTER (trigger IN ('follow_up', 'verification_request')) AS follow_ups, CAST(sum(tool_calls) AS BIGINT) AS tool_calls,
      count(*) FILTER (agent IN ('correlation_agent', 'verification_agent', 'risk_agent', 'recommendation_agent') AND status <> 'completed') AS coord FROM runs GROUP BY repo_id),
    w AS (SELECT repo_id, count(*) FILTER (coverage IN ('partial', 'unavailable')) AS weak FROM cov GROUP BY repo_id)
    SELECT repo_id, agent_runs, agent_failures, retries, follow_ups, tool_calls,
      CASE WHEN weak > 0 OR agent_failures > 0 OR coord > 0 THEN 'completed_with_limitations' ELSE 'completed' END AS status FROM c JOIN w USING (repo_id)""",
    uses=("runs",),
)
def case_status(spark, sf_dir):
    r = runs(spark, sf_dir)
    return activity.case_status(r, activity.coverage(r))


@query(
    "unavailable_agents",
    """SELECT repo_id, agent || '/' || mode AS agent, max(attempt) AS attempts FROM runs GROUP BY repo_id, agent || '/' || mode
    HAVING count(*) FILTER (status = 'completed') = 0 AND max(attempt) > 2""",
    uses=("runs",),
)
def unavailable_agents(spark, sf_dir):
    by_mode = adapt(spark, sf_dir, "runs").withColumn("agent", F.concat_ws("/", "agent", "mode"))
    return activity.unavailable_agents(by_mode, max_retries=2)

"""Queries on listings, counts, guards and upkeep of the case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.operators import risk, store, verify
from riskframe.plans.findings import CONFIDENCE_SQL, RISK_SQL, scored_findings
from riskframe.plans.registry import query
from riskframe.sources.adapters import adapt, table

RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(
    "finding_search",
    f"""WITH {CONFIDENCE_SQL} SELECT repo_id, finding_id FROM scored WHERE status IN ('verified', 'proposed') AND severity = 'high' AND category = 'security'
      AND confidence >= 0.7 AND len(list_filter(affected_files, lambda x: contains(x, 'mod_1'))) > 0""",
    uses=("findings", "evidence"),
)
def finding_search(spark, sf_dir):
    return store.search_findings(
        scored_findings(spark, sf_dir),
        statuses=("verified", "proposed"),
        severity="high",
        category="security",
        min_confidence=0.7,
        file="mod_1",
    ).select("repo_id", "finding_id")


@query(
    "severity_counts",
    """WITH s AS (SELECT unnest(['critical', 'high', 'medium', 'low', 'info']) AS severity), r AS (SELECT DISTINCT repo_id FROM findings)
    SELECT r.repo_id, s.severity, count(f.finding_id) AS n FROM r CROSS JOIN s LEFT JOIN findings f ON f.repo_id = r.repo_id AND f.severity = s.severity GROUP BY ALL""",
    uses=("findings",),
)
def severity_counts(spark, sf_dir):
    return store.severity_counts(adapt(spark, sf_dir, "findings"))


@query(
    "severity_status_matrix",
    "SELECT severity, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in C.STATUSES)
    + " FROM findings GROUP BY severity",
    uses=("findings",),
)
def severity_status_matrix(spark, sf_dir):
    return store.severity_status_matrix(adapt(spark, sf_dir, "findings"))


@query(
    "knowledge_version",
    """SELECT repo_id, count(*) AS version FROM (SELECT repo_id FROM findings UNION ALL SELECT repo_id FROM evidence JOIN findings USING (finding_id)) GROUP BY repo_id""",
    uses=("findings", "evidence"),
)
def knowledge_version(spark, sf_dir):
    findings = adapt(spark, sf_dir, "findings")
    evidence = adapt(spark, sf_dir, "evidence").join(findings.select("finding_id", "repo_id"), "finding_id")
    return store.knowledge_version(findings, evidence)


@query(
    "verification_queue",
    f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {RANK_SQL} DESC, created_at, finding_id) AS position FROM findings
      WHERE status NOT IN ('verified', 'rejected') AND severity <> 'info' AND status <> 'needs_more_evidence')
    SELECT repo_id, finding_id, position FROM q WHERE position <= 60""",
    uses=("findings",),
)
def verification_queue(spark, sf_dir):
    findings = adapt(spark, sf_dir, "findings")
    ready = findings.where(verify.needs_verification(F.lit(False), F.lit(0), F.lit(0)))
    return verify.verification_queue(ready).select("repo_id", "finding_id", "position")


@query(
    "evidence_ids",
    "SELECT f.repo_id, f.finding_id, e.evidence_id FROM findings f LEFT JOIN evidence e ON e.finding_id = f.finding_id",
    uses=("findings", "evidence"),
)
def evidence_ids(spark, sf_dir):
    return store.evidence_of_findings(adapt(spark, sf_dir, "findings"), adapt(spark, sf_dir, "evidence")).drop("evidence_at")


@query(
    "top_risks",
    f"""WITH {RISK_SQL}, p AS (SELECT *, CASE WHEN score >= 80 THEN 0 WHEN score >= 60 THEN 1 WHEN score >= 35 THEN 2 WHEN score >= 12 THEN 3 ELSE 4 END AS pr FROM risks),
    r AS (SELECT repo_id, finding_id, score, row_number() OVER (PARTITION BY repo_id ORDER BY pr, score DESC, finding_id) AS position FROM p)
    SELECT * FROM r WHERE position <= 8""",
    uses=("findings", "evidence"),
)
def top_risks(spark, sf_dir):
    return store.top_risks(risk.finding_risks(scored_findings(spark, sf_dir)), 8).select(
        "repo_id", "finding_id", "score", "position"
    )


@query(
    "first_findings",
    """SELECT repo_id, agent, rule_id, title, arg_min(finding_id, (created_at, finding_id)) AS finding_id FROM findings
    GROUP BY repo_id, agent, rule_id, title, list_sort(affected_files)""",
    uses=("findings",),
)
def first_findings(spark, sf_dir):
    return store.first_findings(adapt(spark, sf_dir, "findings")).select("repo_id", "agent", "rule_id", "title", "finding_id")


@query(
    "refused_drafts",
    """SELECT finding_id FROM findings WHERE NOT is_hypothesis AND finding_id NOT IN (SELECT finding_id FROM evidence WHERE finding_id IS NOT NULL)""",
    uses=("findings", "evidence"),
)
def refused_drafts(spark, sf_dir):
    return store.publishable(adapt(spark, sf_dir, "findings"), adapt(spark, sf_dir, "evidence"))[1].select("finding_id")


def watches(spark, sf_dir):
    base = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return adapt(spark, sf_dir, "watches").withColumn(
        "next_check_at", F.timestamp_micros(F.unix_micros(base) + F.col("next_check_hours") * 3_600_000_000)
    )


@query(
    "due_watches",
    "SELECT watch_id FROM watches WHERE enabled AND frequency <> 'manual' AND status <> 'checking' AND (next_check_hours IS NULL OR next_check_hours <= 0)",
    uses=("watches",),
)
def due_watches(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return store.due_watches(watches(spark, sf_dir), now).select("watch_id")


@query(
    "stuck_watches_reset",
    "SELECT CASE WHEN status = 'checking' THEN 'pending' ELSE status END AS status, count(*) AS n FROM watches GROUP BY 1",
    uses=("watches",),
)
def stuck_watches_reset(spark, sf_dir):
    return store.reset_stuck(watches(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "repository_urls",
    r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo.git' WHEN 1 THEN url WHEN 2 THEN 'http://github.com/a/b'
      WHEN 3 THEN 'https://user@github.com/a/b' ELSE 'https://github.com/topics/repo' || page_id END AS url FROM pages),
    x AS (SELECT *, regexp_extract(url, '^https://([^/?#]*)', 1) AS netloc FROM u)
    SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN contains(netloc, '@') THEN 'credentials' WHEN contains(netloc, ':') THEN 'port'
      WHEN lower(netloc) NOT IN ('github.com', 'www.github.com') THEN 'host' WHEN page_id % 5 = 4 THEN 'owner' END AS reason,
      CASE WHEN page_id % 5 = 0 THEN 'owner' || page_id || '/repo' END AS full_name FROM x""",
)
def repository_urls(spark, sf_dir):
    page = F.col("page_id")
    url = (
        F.when(page % 5 == 0, F.concat(F.lit("https://github.com/owner"), page.cast("string"), F.lit("/repo.git")))
        .when(page % 5 == 1, F.col("url"))
        .when(page % 5 == 2, F.lit("http://github.com/a/b"))
        .when(page % 5 == 3, F.lit("https://user@github.com/a/b"))
        .otherwise(F.concat(F.lit("https://github.com/topics/repo"), page.cast("string")))
    )
    checked = store.validated_repository(table(spark, sf_dir, "pages").select("page_id", url.alias("url")))
    return checked.select("page_id", "reason", F.concat("owner", F.lit("/"), "name").alias("full_name"))


@query(
    "project_sizes",
    "SELECT source AS project_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents GROUP BY source",
)
def project_sizes(spark, sf_dir):
    files = adapt(spark, sf_dir, "files").select(F.col("repo_id").alias("project_id"), F.octet_length("text").alias("size"))
    return store.project_size(files, files.select("project_id").distinct())


@query(
    "upload_limits",
    """WITH inc AS (SELECT l_suppkey AS project_id, 'f' || l_partkey AS path, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS size FROM lineitem GROUP BY ALL),
    kept AS (SELECT DISTINCT l_suppkey AS project_id, 'f' || (l_partkey + l_linenumber) AS path, 10e0 AS size FROM lineitem),
    every AS (SELECT * FROM inc UNION ALL SELECT * FROM kept WHERE (project_id, path) NOT IN (SELECT project_id, path FROM inc))
    SELECT project_id, count(*) AS files, sum(size) AS bytes, count(*) <= 420 AND sum(size) <= 10000 AS accepted FROM every GROUP BY project_id""",
)
def upload_limits(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path")
    project = F.col("l_suppkey").alias("project_id")
    incoming = items.select(
        project,
        path,
        F.col("l_quantity").alias("size"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("position"),
    )
    older = F.concat(F.lit("f"), (F.col("l_partkey") + F.col("l_linenumber")).cast("string")).alias("path")
    kept = items.select(project, older, F.lit(10.0).alias("size")).distinct()
    return store.upload_check(incoming, kept, max_files=420, max_bytes=10_000)


@query(
    "upserted_events",
    """WITH cur AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL), inc AS (SELECT user_id + event_id % 2 * 1000 AS user_id, event_type, min(value) AS value FROM events GROUP BY ALL)
    SELECT coalesce(c.user_id, i.user_id) AS user_id, coalesce(c.event_type, i.event_type) AS event_type, coalesce(i.value, c.value) AS value
    FROM cur c FULL JOIN inc i ON c.user_id = i.user_id AND c.event_type = i.event_type""",
)
def upserted_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    current = events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    moved = (F.col("user_id") + F.col("event_id") % 2 * 1000).alias("user_id")
    incoming = events.groupBy(moved, "event_type").agg(F.min("value").alias("value"))
    return store.upsert(current, incoming, ["user_id", "event_type"])


@query(
    "replaced_children",
    """WITH inc AS (SELECT l_orderkey * 2 AS l_orderkey, l_partkey, l_quantity FROM lineitem)
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM inc) UNION ALL SELECT * FROM inc""",
)
def replaced_children(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    incoming = items.withColumn("l_orderkey", F.col("l_orderkey") * 2)
    return store.replace_children(items, incoming, ["l_orderkey"])


@query(
    "appended_events",
    """WITH hw AS (SELECT repo_id, count(*) AS n FROM trace WHERE ts < TIMESTAMP '2024-01-15' GROUP BY repo_id)
    SELECT t.repo_id, t.event_id, t.message, row_number() OVER (PARTITION BY t.repo_id ORDER BY ts, event_id) + coalesce(n, 0) AS seq FROM trace t LEFT JOIN hw ON hw.repo_id = t.repo_id WHERE ts >= TIMESTAMP '2024-01-15'""",
    uses=("trace",),
)
def appended_events(spark, sf_dir):
    trace = adapt(spark, sf_dir, "trace")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    high_water = trace.where(F.col("ts") < cut).groupBy("repo_id").agg(F.count("*").alias("high_water"))
    return store.append_events(trace.where(F.col("ts") >= cut), high_water).select("repo_id", "event_id", "message", "seq")


@query(
    "latest_runs",
    "SELECT repo_id, agent, arg_max(run_id, (started_at, run_id)) AS run_id FROM runs GROUP BY ALL",
    uses=("runs",),
)
def latest_runs(spark, sf_dir):
    latest = store.latest_per_key(adapt(spark, sf_dir, "runs"), ["repo_id", "agent"], "started_at", "run_id")
    return latest.select("repo_id", "agent", "run_id")


@query(
    "options_in_effect",
    """SELECT o_orderkey AS request_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'deep' END, CASE WHEN c_custkey % 4 = 0 THEN 'quick' END, 'standard') AS depth,
      coalesce(CASE WHEN o_orderkey % 5 = 0 THEN true END, CASE WHEN c_custkey % 2 = 0 THEN false END, true) AS dry_run
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def options_in_effect(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("c_custkey")
    requests = table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(key % 3 == 0, F.lit("deep")).alias("depth"),
        F.when(key % 5 == 0, F.lit(True)).alias("dry_run"),
    )
    users = table(spark, sf_dir, "customer").select(
        customer.alias("user_id"),
        F.when(customer % 4 == 0, F.lit("quick")).alias("depth"),
        F.when(customer % 2 == 0, F.lit(False)).alias("dry_run"),
    )
    chosen = store.effective_options(requests, users, {"depth": "standard", "dry_run": True})
    return chosen.select("request_id", "depth", "dry_run")

"""Streaming queries over the events table, each run to the end of the table and written to a table of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.plans.cases import CHANNELS, RULES, RULES_SQL
from riskframe.functions.lookup import literal_table
from riskframe.plans.registry import query
from riskframe.sources.adapters import ADAPTERS
from riskframe.streaming import streams


def event_stream(spark, sf_dir, columns: dict[str, str]):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = streams.read_events(spark, f"{sf_dir}/events*.parquet", raw)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*[f"{e} AS `{a}`" for a, e in columns.items()])


def finish(spark, name, start):
    """Run ``start(path, checkpoint)`` to its end and read what it wrote."""
    path, checkpoint = streams.new_folder(spark, name), streams.new_folder(spark, f"{name}-checkpoint")
    start(path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_case_counters",
    """SELECT repo_id, count(*) AS agent_runs, count(*) FILTER (status = 'failed') AS agent_failures, count(*) FILTER (trigger = 'retry') AS retries,
      count(*) FILTER (trigger IN ('follow_up', 'verification_request')) AS follow_ups FROM runs GROUP BY repo_id""",
    uses=("runs",),
)
def stream_case_counters(spark, sf_dir):
    counters = streams.case_counters(event_stream(spark, sf_dir, ADAPTERS["runs"][1]))

    def start(path, checkpoint):
        write = lambda batch, _id: batch.write.mode("overwrite").parquet(path)
        return streams.each_batch(counters, write, checkpoint, mode="complete")

    return finish(spark, "case-counters", start)


@query(
    "stream_event_tail",
    "SELECT repo_id, event_id, event_type, message FROM trace",
    uses=("trace",),
)
def stream_event_tail(spark, sf_dir):
    events = streams.redacted(event_stream(spark, sf_dir, ADAPTERS["trace"][1]))
    chosen = events.select("repo_id", "event_id", "event_type", "message")
    return finish(spark, "event-tail", lambda path, checkpoint: streams.append_to_table(chosen, path, checkpoint))


@query(
    "stream_event_sequence",
    "SELECT repo_id, event_id, row_number() OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS seq FROM trace",
    uses=("trace",),
)
def stream_event_sequence(spark, sf_dir):
    events = event_stream(spark, sf_dir, ADAPTERS["trace"][1])
    numbered = finish(spark, "numbered-events", lambda path, checkpoint: streams.append_numbered(events, path, checkpoint))
    return numbered.select("repo_id", "event_id", "seq")


@query(
    "stream_notifications",
    f"""WITH {RULES_SQL}, m AS (SELECT e.event_id, r.channel_id, ch_enabled, verified FROM ev e JOIN rules r ON r.event = e.event JOIN channels c ON c.channel_id = r.channel_id
      WHERE CASE rule_id WHEN 'r2' THEN coalesce(top_priority <= 'P2', false) WHEN 'r3' THEN impact_level IN ('high', 'breaking') WHEN 'r4' THEN project_id = '3' WHEN 'r6' THEN watch_id = '1' ELSE true END)
    SELECT event_id, channel_id, CASE WHEN any_value(ch_enabled) AND any_value(verified) THEN 'send' ELSE 'skipped' END AS status FROM m GROUP BY ALL""",
)
def stream_notifications(spark, sf_dir):
    columns = {
        "user_id": "CAST(0 AS INT)",
        "event_id": "event_id",
        "ts": "ts",
        "event": "event_type",
        "top_priority": "CASE event_id % 6 WHEN 5 THEN NULL ELSE concat('P', event_id % 6) END",
        "impact_level": "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'breaking' END",
        "project_id": "CAST(user_id % 5 AS STRING)",
        "watch_id": "CAST(user_id % 3 AS STRING)",
    }
    channels = literal_table(spark, CHANNELS, "user_id int, channel_id string, kind string, enabled boolean, verified boolean")
    rules = literal_table(
        spark, RULES, "user_id int, rule_id string, event string, channel_ids array<string>, filters map<string,string>, enabled boolean"
    )
    deliveries = streams.dispatch_stream(event_stream(spark, sf_dir, columns), rules, channels)
    chosen = deliveries.select("event_id", "channel_id", "status")
    return finish(spark, "deliveries", lambda path, checkpoint: streams.append_to_table(chosen, path, checkpoint))


@query("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    hits = event_stream(spark, sf_dir, {"repo_id": "user_id", "event_id": "event_id", "ts": "ts"})
    decided = streams.rate_limited(hits, "repo_id", "ts", "event_id", per_minute=3, window_seconds=21_600)
    return finish(spark, "rate-limit", lambda path, checkpoint: streams.append_to_table(decided, path, checkpoint))


@query(
    "stream_watch_timers",
    """WITH c AS (SELECT user_id AS watch_id, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY user_id),
    t AS (SELECT watch_id, min(last + CASE event_type WHEN 'click' THEN 24 WHEN 'purchase' THEN 168 ELSE 1 END * 3600000) AS due
      FROM c JOIN events e ON e.user_id = c.watch_id AND epoch_us(e.ts) // 1000 = c.last GROUP BY watch_id)
    SELECT watch_id, due AS due_ms FROM t WHERE due < (SELECT max(epoch_us(ts) // 1000) FROM events)""",
)
def stream_watch_timers(spark, sf_dir):
    hours = "CASE event_type WHEN 'click' THEN 24 WHEN 'purchase' THEN 168 ELSE 1 END"
    checks = event_stream(spark, sf_dir, {"watch_id": "user_id", "ts": "ts", "hours": hours})
    due = streams.due_by_timer(checks, "watch_id", "ts", "hours").select("watch_id", F.unix_millis("due_at").alias("due_ms"))
    return finish(spark, "watch-timers", lambda path, checkpoint: streams.append_to_table(due, path, checkpoint))

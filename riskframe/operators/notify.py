"""Notification rules against events: validation, matching, deliveries, subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import lookup


def validated_rules(rules: DataFrame, channels: DataFrame, catalog: dict[str, tuple[str, ...]] = C.NOTIFICATION_EVENTS) -> DataFrame:
    """Rules with the filters their event allows; ``reason`` tells why a rule is refused.

    ``rules(user_id, rule_id, event, channel_ids, filters, enabled)``, ``channels(user_id, channel_id, …)``.
    """
    allowed = lookup_list(F.col("event"), catalog)
    kept = F.map_filter("filters", lambda k, v: F.array_contains(allowed, k) & v.isNotNull() & (v != ""))
    named = rules.select("user_id", "rule_id", F.explode("channel_ids").alias("channel_id"))
    unknown = (
        named.join(channels.select("user_id", "channel_id"), ["user_id", "channel_id"], "left_anti")
        .select("user_id", "rule_id")
        .distinct()
        .withColumn("_unknown", F.lit(True))
    )
    priority, impact = F.try_element_at("filters", F.lit("min_priority")), F.try_element_at("filters", F.lit("min_impact"))
    reason = (
        F.when(~F.col("event").isin(*catalog), F.lit("unknown event"))
        .when(F.coalesce("_unknown", F.lit(False)), F.lit("unknown channel"))
        .when(priority.isNotNull() & ~priority.isin(*C.PRIORITY_RANK), F.lit("min_priority"))
        .when(impact.isNotNull() & ~impact.isin(*C.IMPACT_RANK), F.lit("min_impact"))
    )
    return (
        rules.withColumns({"filters": F.coalesce(kept, F.create_map().cast("map<string,string>")), "channel_ids": F.array_distinct("channel_ids")})
        .join(unknown, ["user_id", "rule_id"], "left")
        .withColumn("reason", reason)
        .drop("_unknown")
    )


def lookup_list(key: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for name, values in table.items():
        items = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        out = F.when(key == name, items) if out is None else out.when(key == name, items)
    return out.otherwise(F.array().cast("array<string>"))


def rule_matches() -> Column:
    """Does the event's context pass the rule's filters? Reads ``filters, top_priority, impact_level, project_id, watch_id``."""
    value = lambda key: F.try_element_at("filters", F.lit(key))
    by_priority = value("min_priority").isNull() | (
        F.col("top_priority").isNotNull()
        & (lookup(F.col("top_priority"), C.PRIORITY_RANK, 9) <= lookup(value("min_priority"), C.PRIORITY_RANK, 9))
    )
    by_impact = value("min_impact").isNull() | (
        lookup(F.coalesce("impact_level", F.lit("none")), C.IMPACT_RANK, 0) >= lookup(value("min_impact"), C.IMPACT_RANK, 0)
    )
    same = lambda key: value(key).isNull() | (value(key) == "") | F.coalesce(value(key) == F.col(key), F.lit(False))
    return by_priority & by_impact & same("project_id") & same("watch_id")


def matched_channels(events: DataFrame, rules: DataFrame, channels: DataFrame) -> DataFrame:
    """Every rule and channel an event goes to; also usable with a stream of events."""
    active = rules.where("enabled").select(
        "user_id", "rule_id", "event", "filters", F.posexplode(F.array_distinct("channel_ids")).alias("_pos", "channel_id")
    )
    reachable = channels.select("user_id", "channel_id", "kind", "verified", F.col("enabled").alias("channel_enabled"))
    status = F.when(F.col("channel_enabled") & F.col("verified"), F.lit("send")).otherwise(F.lit("skipped"))
    error = F.when(~F.col("channel_enabled"), F.lit("channel disabled")).when(~F.col("verified"), F.lit("channel not verified"))
    return (
        events.join(active, ["user_id", "event"])
        .where(rule_matches())
        .join(reachable, ["user_id", "channel_id"])
        .withColumns({"status": status, "error": error})
    )


def dispatch(events: DataFrame, rules: DataFrame, channels: DataFrame) -> DataFrame:
    """One delivery per event and channel, by the first matching rule; unusable channels keep a skipped row."""
    matched = matched_channels(events, rules, channels)
    return (
        matched.groupBy("user_id", "event_id", "event", "channel_id")
        .agg(F.min_by(F.struct("rule_id", "status", "error"), F.struct("rule_id", "_pos")).alias("_d"))
        .select("user_id", "event_id", "event", "channel_id", "_d.*")
    )


def subscriptions(rules: DataFrame) -> DataFrame:
    """Distinct events each channel receives."""
    return (
        rules.select("user_id", "event", F.explode("channel_ids").alias("channel_id"))
        .groupBy("user_id", "channel_id")
        .agg(F.array_sort(F.collect_set("event")).alias("events"))
    )


def case_notifications(cases: DataFrame, risks: DataFrame, items: int = 6, urgent: int = 8) -> DataFrame:
    """Messages of finished cases: failed; or completed, and one about the top risk when there is any.

    ``cases(repo_id, user_id, status)``. Top risks are ranked with a limit that applies before the shuffle.
    """
    rank = lookup(F.col("priority"), C.PRIORITY_RANK, 9)
    order = Window.partitionBy("repo_id").orderBy(rank, F.col("score").desc(), F.col("finding_id"))
    top = risks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(items, urgent))
    line = F.struct("_n", F.concat_ws(" ", "priority", "title").alias("t"), rank.alias("r"))
    summary = top.groupBy("repo_id").agg(
        F.min_by("priority", "_n").alias("top_priority"), F.array_sort(F.collect_list(line)).alias("_lines")
    )
    shown = F.transform(F.slice("_lines", 1, items), lambda x: x["t"])
    pressing = F.slice(F.transform(F.filter("_lines", lambda x: x["r"] <= 2), lambda x: x["t"]), 1, urgent)
    stopped = F.col("status").isin("failed", "cancelled")
    messages = F.array_compact(
        F.array(
            F.when(stopped, F.struct(F.lit("investigation.failed").alias("event"), F.array().cast("array<string>").alias("items"))),
            F.when(~stopped, F.struct(F.lit("investigation.completed").alias("event"), F.coalesce(shown, F.array().cast("array<string>")).alias("items"))),
            F.when(
                ~stopped & F.col("top_priority").isNotNull(),
                F.struct(F.lit("investigation.risk").alias("event"), pressing.alias("items")),
            ),
        )
    )
    return (
        cases.where(~F.col("status").isin("queued", "running"))
        .join(summary, "repo_id", "left")
        .select("repo_id", "user_id", "top_priority", F.inline(messages))
    )

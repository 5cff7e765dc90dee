"""Selections, listings and guards over the case tables, and their upkeep (append, upsert, replace)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import lookup, severity_rank
from riskframe.functions.paths import clean_path
from riskframe.functions.text import redact


# ------------------------------------------------------------------------------------------ queries
def search_findings(
    findings: DataFrame,
    statuses: tuple[str, ...] = (),
    severity: str | None = None,
    category: str | None = None,
    agent: str | None = None,
    min_confidence: float | None = None,
    file: str | None = None,
) -> DataFrame:
    """Findings that meet every given condition. The plain ones reach the scan; ``file`` matches inside the list."""
    df = findings
    if statuses:
        df = df.where(F.col("status").isin(*statuses))
    for name, value in (("severity", severity), ("category", category), ("agent", agent)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if min_confidence is not None:
        df = df.where(F.col("confidence") >= min_confidence)
    if file is not None:
        df = df.where(F.exists("affected_files", lambda f: F.contains(f, F.lit(file))))
    return df


def visible_cases(cases: DataFrame, viewer: str | None, limit: int) -> DataFrame:
    """Cases the viewer owns and those without an owner, newest first."""
    mine = F.col("owner_id").isNull() if viewer is None else (F.col("owner_id") == viewer) | F.col("owner_id").isNull()
    return cases.where(mine).orderBy(F.col("created_at").desc(), F.col("repo_id")).limit(limit)


def case_summary(cases: DataFrame) -> DataFrame:
    """Summary columns with the duration in seconds; open cases have none."""
    micros = F.unix_micros("completed_at") - F.unix_micros("started_at")
    return cases.withColumn("duration_seconds", micros / 1_000_000)


def event_tail(events: DataFrame, after_seq: int, limit: int) -> DataFrame:
    """The next events of every case after a sequence number. Sequence numbers are dense, so a range is enough."""
    return events.where((F.col("seq") > after_seq) & (F.col("seq") <= after_seq + limit))


def timeline(
    events: DataFrame,
    groups: Mapping[str, tuple[str, ...]] | None = None,
    group: str | None = None,
    agent: str | None = None,
    text: str | None = None,
    last: int | None = None,
    extra: Column | None = None,
) -> DataFrame:
    """The trace filtered by event group, agent on either end and text; ``last`` keeps the newest rows per case."""
    groups = groups or C.EVENT_GROUPS
    df = events
    if group is not None:
        df = df.where(F.col("event_type").isin(*groups[group]))
    if agent is not None:
        df = df.where((F.col("sender") == agent) | (F.col("receiver") == agent))
    if text:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", "message", "event_type")), F.lit(text.lower())))
    if extra is not None:
        df = df.where(extra)
    if last is None:
        return df
    newest = Window.partitionBy("repo_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= last).drop("_rank")


def due_watches(watches: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Enabled, not manual, not being checked, and due; those never checked come first."""
    due = watches.where(
        F.col("enabled")
        & (F.col("frequency") != "manual")
        & (F.col("status") != "checking")
        & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))
    ).orderBy(F.col("next_check_at").asc_nulls_first(), F.col("watch_id"))
    return due if limit is None else due.limit(limit)


def reset_stuck(watches: DataFrame) -> DataFrame:
    return watches.withColumn("status", F.when(F.col("status") == "checking", F.lit("pending")).otherwise(F.col("status")))


def effective_options(requests: DataFrame, users: DataFrame, server: Mapping[str, object]) -> DataFrame:
    """Each option from the request, else the user's default, else the server's."""
    joined = requests.join(users.select("user_id", *[F.col(k).alias(f"_user_{k}") for k in server]), "user_id", "left")
    chosen = {k: F.coalesce(F.col(k), F.col(f"_user_{k}"), F.lit(v)) for k, v in server.items()}
    return joined.withColumns(chosen).drop(*[f"_user_{k}" for k in server])


def latest_per_key(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The newest row per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, tie)).alias("_row"))
    return best.select(*keys, "_row.*")


def evidence_of_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Finding and evidence ids side by side, one row per item, in creation order within a finding.

    Long form: the evidence of one finding is never gathered into a list in one task.
    """
    return findings.select("repo_id", "finding_id").join(
        evidence.select("finding_id", "evidence_id", F.col("created_at").alias("evidence_at")), "finding_id", "left"
    )


def with_latest_verification(findings: DataFrame, verifications: DataFrame) -> DataFrame:
    latest = (
        verifications.where(F.col("finding_id").isNotNull())
        .groupBy("repo_id", "finding_id")
        .agg(
            F.max_by(F.struct("decision", "confidence", "round"), F.struct("verified_at", "round")).alias("verification")
        )
    )
    return findings.join(latest, ["repo_id", "finding_id"], "left")


def first_findings(drafts: DataFrame) -> DataFrame:
    """One finding per case, agent, rule, title and set of files: the earliest report stays."""
    rest = [c for c in drafts.columns if c not in ("repo_id", "agent", "rule_id", "title")]
    return (
        drafts.withColumn("_files", F.array_sort("affected_files"))
        .groupBy("repo_id", "agent", "rule_id", "title", "_files")
        .agg(F.min_by(F.struct(*rest), F.struct("created_at", "finding_id")).alias("_row"))
        .select("repo_id", "agent", "rule_id", "title", "_row.*")
    )


# ------------------------------------------------------------------------------------------- counts
def severity_counts(findings: DataFrame) -> DataFrame:
    """Count per case and severity, with zeros."""
    counted = findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES]
    )
    pairs = ", ".join(f"'{s}', `{s}`" for s in C.SEVERITIES)
    return counted.selectExpr("repo_id", f"stack({len(C.SEVERITIES)}, {pairs}) AS (severity, n)")


def severity_status_matrix(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").pivot("status", list(C.STATUSES)).count().na.fill(0)


def knowledge_version(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings plus evidence per case: grows with every addition."""
    parts = findings.select("repo_id").unionByName(evidence.select("repo_id"))
    return parts.groupBy("repo_id").agg(F.count("*").alias("version"))


def project_size(files: DataFrame, projects: DataFrame) -> DataFrame:
    sizes = files.groupBy("project_id").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))
    return projects.join(sizes, "project_id", "left").na.fill(0, ["file_count", "total_bytes"])


# ------------------------------------------------------------------------------------------- guards
def publishable(drafts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split drafts: hypotheses and findings with evidence pass, the others are refused."""
    backed = evidence.select("finding_id").where(F.col("finding_id").isNotNull()).distinct()
    hypothesis = F.coalesce(F.col("is_hypothesis"), F.lit(False))
    marked = drafts.join(backed.withColumn("_backed", F.lit(True)), "finding_id", "left")
    ok = hypothesis | F.coalesce(F.col("_backed"), F.lit(False))
    return marked.where(ok).drop("_backed"), marked.where(~ok).drop("_backed")


def invalid_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence whose path leaves the repository or whose line range runs backwards."""
    bad_path = F.col("file").isNotNull() & clean_path(F.col("file")).isNull()
    bad_range = F.coalesce(F.col("line_end") < F.col("line_start"), F.lit(False))
    return evidence.where(bad_path | bad_range).withColumn(
        "reason", F.when(bad_path, F.lit("path")).otherwise(F.lit("line order"))
    )


def upload_check(incoming: DataFrame, kept: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Per project: would kept plus new files fit? The last write of a path wins; ``incoming`` has a ``position``."""
    new = incoming.groupBy("project_id", "path").agg(F.max_by("size", "position").alias("size"))
    stay = kept.select("project_id", "path", "size").join(new, ["project_id", "path"], "left_anti")
    return (
        new.unionByName(stay)
        .groupBy("project_id")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        .withColumn("accepted", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))
    )


def validated_repository(urls: DataFrame, url: str = "url") -> DataFrame:
    """Normalise repository addresses: adds ``owner``, ``name`` and ``reason`` (null when the address is fine)."""
    raw = F.trim(F.col(url))
    rest = F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    netloc = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    owner = F.get(parts, F.lit(0))
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    reserved = ("settings", "orgs", "marketplace", "explore", "topics", "login", "about", "features")
    reason = (
        F.when(F.rlike(F.col(url), F.lit(r"[\x00-\x1f\x7f]")), F.lit("control characters"))
        .when((raw == "") | (F.length(raw) > 300), F.lit("empty or too long"))
        .when(F.rlike(raw, F.lit(r"[ %\\]")), F.lit("forbidden characters"))
        .when(~raw.startswith("https://"), F.lit("scheme"))
        .when(F.contains(netloc, F.lit("@")), F.lit("credentials"))
        .when(F.contains(netloc, F.lit(":")), F.lit("port"))
        .when(~F.lower(netloc).isin("github.com", "www.github.com"), F.lit("host"))
        .when(F.rlike(rest, F.lit(r"[?#]")), F.lit("query or fragment"))
        .when(F.size(parts) != 2, F.lit("path"))
        .when(
            ~F.rlike(owner, F.lit(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$")) | F.lower(owner).isin(*reserved), F.lit("owner")
        )
        .when(~F.rlike(name, F.lit(r"^[A-Za-z0-9._-]{1,100}$")) | name.startswith("."), F.lit("name"))
    )
    return (
        urls.withColumn("reason", reason)
        .withColumn("owner", F.when(F.col("reason").isNull(), owner))
        .withColumn("name", F.when(F.col("reason").isNull(), name))
    )


def valid_branch(branch: Column) -> Column:
    """The trimmed branch name; null when it is not a safe reference name."""
    name = F.trim(branch)
    ok = F.rlike(name, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._/\-]{0,199}$")) & ~F.rlike(
        name, F.lit(r"\.\.|//|@\{|/$|\.$|\.lock$|/\.")
    )
    return F.when(ok, name)


def hosted_repositories(repos: DataFrame, show_private: bool, text: str | None = None) -> DataFrame:
    """A hosting account's repositories, without private ones unless asked for, by part of name or description."""
    df = repos if show_private else repos.where(~F.col("private"))
    if text:
        words = F.lower(F.concat_ws(" ", "full_name", "description"))
        df = df.where(F.contains(words, F.lit(text.lower())))
    return df


# ------------------------------------------------------------------------------------------- upkeep
def append_events(events: DataFrame, high_water: DataFrame) -> DataFrame:
    """New events with redacted messages and sequence numbers that continue each case's numbering."""
    from riskframe.operators.sequence import with_sequence

    clean = events.withColumn("message", redact(F.col("message")))
    return with_sequence(clean, ["repo_id"], "ts", "event_id", start=high_water)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace current rows of the same key; columns the incoming side lacks keep their value."""
    shared = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, F.struct(*shared).alias("_new"))
    joined = current.join(new, keys, "full_outer")
    columns = [F.col(k) for k in keys]
    for name in current.columns:
        if name in keys:
            continue
        if name in shared:
            columns.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def replace_children(current: DataFrame, incoming: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of the parents that ``incoming`` names are replaced by its rows."""
    return current.join(incoming.select(*parent).distinct(), parent, "left_anti").unionByName(incoming)


def top_risks(risks: DataFrame, per_case: int, priorities: tuple[str, ...] = ()) -> DataFrame:
    """The first risks of each case by priority, then score."""
    df = risks.where(F.col("priority").isin(*priorities)) if priorities else risks
    order = Window.partitionBy("repo_id").orderBy(
        lookup(F.col("priority"), C.PRIORITY_RANK, 9), F.col("score").desc(), F.col("finding_id")
    )
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_case)


def worst_first(findings: DataFrame, per_case: int) -> DataFrame:
    order = Window.partitionBy("repo_id").orderBy(severity_rank(F.col("severity")).desc(), F.col("finding_id"))
    return findings.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_case)

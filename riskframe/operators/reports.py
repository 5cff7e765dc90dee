"""Case reports and traces as ordered rows.

A case can be as large as the cluster's data, so a report is never gathered into one document in one task. It is a table
of rows with a section and a position; the writers range-partition it by them, and a case's part files are its report in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = ("case", "agents", "findings", "correlations", "verifications", "risks", "recommendations", "events")


def order_key(df: DataFrame, order: list[Column]) -> Column:
    """A string that sorts as the columns do: numbers, instants and flags by value (negate one to turn it round), nulls
    first. Numbers count to ten decimals and below 1e20."""
    kinds = df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).schema.fields
    parts = []
    for column, field in zip(order, kinds, strict=True):
        if not isinstance(field.dataType, T.StringType):
            number = F.unix_micros(column) if isinstance(field.dataType, T.TimestampType) else column
            shifted = number.cast("decimal(31,10)") + F.lit("100000000000000000000").cast("decimal(31,10)")
            column = F.lpad(shifted.cast("string"), 34, "0")
        parts.append(F.coalesce(F.concat(F.lit("+"), column), F.lit("")))
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def _rows(df: DataFrame, section: str, order: list[Column], payload: list[str] | None = None) -> DataFrame:
    columns = payload or [c for c in df.columns if c != "repo_id"]
    position = order_key(df, order)
    return df.select(
        "repo_id",
        F.lit(SECTIONS.index(section)).alias("section_no"),
        F.lit(section).alias("section"),
        position.alias("order_key"),
        F.to_json(F.struct(*columns)).alias("item"),
    )


def case_report(tables: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """The report of all cases: one JSON item per row. ``tables`` maps sections to a table and its order columns."""
    out = None
    for section, (df, order) in tables.items():
        rows = _rows(df, section, order)
        out = rows if out is None else out.unionByName(rows)
    return out


def event_line() -> Column:
    return F.format_string(
        "- **[%03d] `%s` → `%s`** (`%s`): %s", "seq", "sender", F.coalesce("receiver", F.lit("orchestrator")), "event_type", "message"
    )


def trace_lines(runs: DataFrame, events: DataFrame, verifications: DataFrame, risks: DataFrame) -> DataFrame:
    """The execution trace as text lines: agents, events, rulings, risks, with headings; ``repo_id, part, position, line``."""

    def part(df: DataFrame, number: int, position: Column, line: Column) -> DataFrame:
        return df.select(
            "repo_id", F.lit(number).alias("part"), position.cast("double").alias("position"), F.lit("").alias("tie"), line.alias("line")
        )

    agent = F.format_string("| %s | %s | %s | %d | %d |", "agent", "mode", "status", "findings_count", F.col("duration_s") * 1000)
    ruling = F.format_string("- **%s**: ruling = `%s`, confidence %.2f", F.col("finding_id").cast("string"), "decision", "confidence")
    risk_line = F.format_string("- **%s** · score `%.1f` · %s", "priority", "score", "title")
    cases = (
        runs.select("repo_id").unionByName(events.select("repo_id")).unionByName(risks.select("repo_id")).distinct()
    )
    titles = ("Active agents", "Execution chronology", "Verification rulings", "Risk assessment")
    headings = cases.select(
        "repo_id",
        F.explode(F.array(*[F.struct(F.lit(i + 1).alias("part"), F.lit(f"## {i + 1}. {t}").alias("line")) for i, t in enumerate(titles)])).alias("h"),
    ).select("repo_id", "h.part", F.lit(float("-inf")).alias("position"), F.lit("").alias("tie"), "h.line")
    return (
        headings.unionByName(part(runs, 1, F.unix_micros("started_at"), agent))
        .unionByName(part(events, 2, F.col("seq"), event_line()))
        .unionByName(part(verifications, 3, F.unix_micros("verified_at"), ruling))
        .unionByName(part(risks, 4, -F.col("score"), risk_line))
        .drop("tie")
    )


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, one folder per case, in order across its part files."""
    (
        report.repartitionByRange("repo_id", "section_no", "order_key")
        .sortWithinPartitions("repo_id", "section_no", "order_key")
        .select("repo_id", "section", "item")
        .write.partitionBy("repo_id")
        .mode("overwrite")
        .json(path)
    )


def write_trace(lines: DataFrame, path: str) -> None:
    (
        lines.repartitionByRange("repo_id", "part", "position", "line")
        .sortWithinPartitions("repo_id", "part", "position", "line")
        .select("repo_id", "line")
        .write.partitionBy("repo_id")
        .mode("overwrite")
        .text(path)
    )


def attach_evidence(evidence: DataFrame, added: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hash the referenced lines of new evidence, append it, and name the findings whose confidence must be recomputed."""
    from riskframe.functions.text import line_range_hash

    texts = files.select("repo_id", F.col("path").alias("file"), "text")
    hashed = (
        added.drop("content_hash")
        .join(texts, ["repo_id", "file"], "left")
        .withColumn("content_hash", line_range_hash(F.col("text"), F.col("line_start"), F.col("line_end")))
        .drop("text")
    )
    return evidence.unionByName(hashed.select(*evidence.columns)), added.select("repo_id", "finding_id").distinct()


def project_overview(projects: DataFrame, watches: DataFrame, reports: DataFrame) -> DataFrame:
    """Projects with their watches, the newest report of each, and the worst impact of the project."""
    from riskframe import constants as C
    from riskframe.functions.lookup import lookup

    newest = reports.groupBy("watch_id").agg(F.max_by(F.struct("report_id", "impact_level"), F.struct("created_at", "report_id")).alias("_r"))
    rows = (
        projects.join(watches.select("project_id", "watch_id"), "project_id", "left")
        .join(newest.select("watch_id", "_r.*"), "watch_id", "left")
    )
    worst = rows.groupBy("project_id").agg(
        F.max_by("impact_level", lookup(F.col("impact_level"), C.IMPACT_RANK, -1)).alias("worst_impact")
    )
    return rows.join(worst, "project_id")


def delivery_log(deliveries: DataFrame, limit: int) -> DataFrame:
    """The newest deliveries of each user."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("delivery_id").desc())
    return deliveries.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)

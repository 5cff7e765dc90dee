"""Questions about a case: which topic owns them, and which findings answer them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import severity_rank
from riskframe.functions.text import terms

DEFAULT_TOPIC = "orchestrator"


def topic_hits(question: Column, topics: Mapping[str, tuple[str, ...]] = C.TOPIC_KEYWORDS) -> Column:
    """Array of ``topic, position, hits`` for topics with at least one keyword in the question."""
    lower = F.lower(question)
    counted = [
        F.struct(
            F.lit(name).alias("topic"),
            F.lit(position).alias("position"),
            sum((F.contains(lower, F.lit(k)).cast("int") for k in keywords), F.lit(0)).alias("hits"),
        )
        for position, (name, keywords) in enumerate(topics.items())
    ]
    return F.filter(F.array(*counted), lambda t: t["hits"] > 0)


def route_questions(
    questions: DataFrame, topics: Mapping[str, tuple[str, ...]] = C.TOPIC_KEYWORDS, findings: DataFrame | None = None
) -> DataFrame:
    """The topic of each question: most keyword hits, ties by topic order; a mentioned file adds a hit for its owner.

    ``questions(question_id, repo_id, text)``; ``findings(repo_id, finding_id, agent, affected_files)``.
    """
    hits = questions.select("question_id", F.inline(topic_hits(F.col("text"), topics)))
    if findings is not None:
        # Words that look like paths are joined to the files of findings; no text is compared with every file.
        words = questions.select(
            "question_id",
            "repo_id",
            F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_./-]+"), F.lit(0)))).alias("_w"),
        ).withColumn("_w", F.regexp_replace("_w", r"^[./]+|[./]+$", ""))
        owners = findings.where(F.col("agent").isin(*topics)).select(
            "repo_id", "finding_id", "agent", F.explode("affected_files").alias("_f")
        ).withColumn("_w", F.lower("_f"))
        positions = F.coalesce(*[F.when(F.col("agent") == name, F.lit(i)) for i, name in enumerate(topics)])
        mentioned = (
            words.join(owners, ["repo_id", "_w"])
            .select("question_id", "finding_id", "agent")
            .distinct()
            .groupBy("question_id", F.col("agent").alias("topic"))
            .agg(F.count("*").cast("int").alias("hits"))
            .withColumn("agent", F.col("topic"))
            .select("question_id", "topic", positions.alias("position"), "hits")
        )
        hits = hits.unionByName(mentioned).groupBy("question_id", "topic", "position").agg(F.sum("hits").alias("hits"))
    best = hits.groupBy("question_id").agg(
        F.min_by(F.struct("topic", "hits"), F.struct(-F.col("hits"), F.col("position"))).alias("_b")
    )
    return (
        questions.join(best, "question_id", "left")
        .withColumns({"topic": F.coalesce("_b.topic", F.lit(DEFAULT_TOPIC)), "hits": F.coalesce("_b.hits", F.lit(0))})
        .drop("_b")
    )


def finding_words() -> Column:
    return F.concat_ws(
        " ", "title", "description", "subject", F.array_join("affected_files", " "), F.translate("rule_id", "._", "  ")
    )


def rank_findings(questions: DataFrame, findings: DataFrame, most: int = 8) -> DataFrame:
    """The most relevant findings of a question's case: shared terms (two fewer when rejected), severity, confidence.

    ``questions(question_id, repo_id, text)``. Overlaps come from joining terms; findings that share no term rank by
    severity and confidence, which is the same for every question of a case and is prepared once per case.
    """
    if "description" not in findings.columns:
        findings = findings.withColumn("description", F.lit(""))
    asked = questions.select("question_id", "repo_id", F.explode(terms(F.col("text"))).alias("_t"))
    words = findings.select("repo_id", "finding_id", F.explode(terms(finding_words())).alias("_t"))
    overlap = (
        words.join(asked, ["repo_id", "_t"]).groupBy("question_id", "finding_id").agg(F.count("*").alias("overlap"))
    )
    base = findings.select(
        "repo_id",
        "finding_id",
        (F.col("status") == "rejected").alias("_rejected"),
        severity_rank(F.col("severity")).alias("_severity"),
        "confidence",
    )
    penalty = F.when(F.col("_rejected"), F.lit(-2)).otherwise(F.lit(0))
    order = [F.col("score").desc(), F.col("_severity").desc(), F.col("confidence").desc(), F.col("finding_id")]
    # Without shared terms only the first few findings per case can appear in any answer.
    per_case = Window.partitionBy("repo_id").orderBy(*order)
    leaders = base.withColumn("score", penalty).withColumn("_n", F.row_number().over(per_case)).where(F.col("_n") <= most)
    unmatched = (
        questions.select("question_id", "repo_id")
        .join(leaders.drop("_n"), "repo_id")
        .join(overlap.select("question_id", "finding_id"), ["question_id", "finding_id"], "left_anti")
        .withColumn("overlap", F.lit(0).cast("bigint"))
    )
    matched = overlap.join(base, "finding_id").withColumn("score", F.col("overlap") + penalty)
    columns = ["question_id", "repo_id", "finding_id", "overlap", "score", "_severity", "confidence"]
    every = matched.select(*columns).unionByName(unmatched.withColumn("score", F.col("score").cast("bigint")).select(*columns))
    per_question = Window.partitionBy("question_id").orderBy(*order)
    return (
        every.withColumn("position", F.row_number().over(per_question))
        .where(F.col("position") <= most)
        .drop("_severity")
    )


def evidence_for_answers(ranked: DataFrame, evidence: DataFrame, findings_shown: int = 6, items: int = 2) -> DataFrame:
    """The first evidence of the first findings of each answer."""
    shown = ranked.where(F.col("position") <= findings_shown).select("question_id", "finding_id", "position")
    wanted = shown.select("finding_id").distinct()
    order = Window.partitionBy("finding_id").orderBy("created_at", "evidence_id")
    first = (
        evidence.join(wanted, "finding_id", "left_semi")
        .withColumn("item", F.row_number().over(order))
        .where(F.col("item") <= items)
        .select("finding_id", "evidence_id", "item")
    )
    return shown.join(first, "finding_id")


def rank_verifications(verifications: DataFrame, most: int = 12) -> DataFrame:
    """Rejections first, then by confidence."""
    order = Window.partitionBy("repo_id").orderBy(
        (F.col("decision") != "rejected").cast("int"), F.col("confidence").desc(), F.col("finding_id")
    )
    return verifications.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)

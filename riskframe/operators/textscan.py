"""Scans over file texts: secrets, machine-directed instructions, patterns, duplicated blocks, licenses, changelogs.

A file's text is one row, so everything inside a file is done on arrays in that row; only hits leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions import paths
from riskframe.functions.licenses import normalise_expression, spdx_header
from riskframe.functions.text import LINE_BREAK, clean_markup, mask, may_hold_secret, split_lines, strip

# Secret rules: id, pattern, group of the value, severity.
SECRET_RULES = (
    ("secret.github_token", C.REDACTIONS[0][1], 0, "critical"),
    ("secret.github_pat", C.REDACTIONS[1][1], 0, "critical"),
    ("secret.openai_key", C.REDACTIONS[2][1], 0, "critical"),
    ("secret.aws_access_key", C.REDACTIONS[3][1], 0, "critical"),
    ("secret.slack_token", C.REDACTIONS[4][1], 0, "high"),
    ("secret.generic_assignment", C.REDACTIONS[8][1], 2, "high"),
)
# A value or its surroundings with one of these words documents a placeholder.
PLACEHOLDER_WORDS = r"(?i)example|dummy|placeholder|changeme|sample|not[ _-]a[ _-]real|fake"
SCRIPT_SINKS = r"\beval\(|\.innerHTML\s*=|child_process\.exec\("
DOCUMENT_SUFFIXES = (".md", ".rst", ".txt", ".html")
DUPLICATE_LINES = 6


def search_lines(files: DataFrame, pattern: str, suffixes: Sequence[str] = (), skip_tests: bool = False) -> DataFrame:
    """Lines a pattern matches, each tried on its own and whole."""
    df = files
    if suffixes:
        df = df.where(F.coalesce(paths.suffix(F.col("path")).isin(*suffixes), F.lit(False)))
    if skip_tests:
        df = df.where(~paths.is_test_path(F.col("path")))
    hits = F.filter(
        F.transform(
            split_lines(F.col("text")), lambda text, i: F.struct((i + 1).alias("line"), text.alias("t"))
        ),
        lambda x: F.rlike(x["t"], F.lit(pattern)),
    )
    return df.select("repo_id", "path", F.inline(hits)).select("repo_id", "path", "line", strip(F.col("t")).alias("excerpt"))


def script_sinks(files: DataFrame, suffixes: Sequence[str] = ("js", "ts", "jsx", "tsx")) -> DataFrame:
    """Lines of scripts that feed code, markup or a shell from text."""
    return search_lines(files, SCRIPT_SINKS, suffixes, skip_tests=True).withColumn(
        "rule_id", F.lit("security.js_dangerous_sink")
    )


# ----------------------------------------------------------------------------------------- secrets
def _secret_hits(files: DataFrame) -> DataFrame:
    """Hits with the plain value: internal, never written out."""
    numbered = F.transform(
        split_lines(F.col("text")),
        lambda text, i: F.struct((i + 1).alias("line"), text.alias("line_text")),
    )
    candidates = F.filter(numbered, lambda x: may_hold_secret(x["line_text"]))
    lined = files.where(may_hold_secret(F.col("text"))).select("repo_id", "path", "text", F.inline(candidates))

    def values(rule: str, pattern: str, group: int, severity: str) -> Column:
        return F.transform(
            F.regexp_extract_all("line_text", F.lit(pattern), F.lit(group)),
            lambda v: F.struct(F.lit(rule).alias("rule_id"), v.alias("value"), F.lit(severity).alias("severity")),
        )

    hits = F.flatten(F.array(*[values(*rule) for rule in SECRET_RULES]))
    return lined.select("repo_id", "path", "line", "text", F.inline(hits))


def secret_scan(files: DataFrame) -> DataFrame:
    """Credential-shaped values with their rule and severity; values are masked."""
    return _secret_hits(files).select(
        "repo_id", "path", "line", "rule_id", mask(F.col("value")).alias("masked"), "severity"
    )


def placeholder_judgement(files: DataFrame) -> DataFrame:
    """Per hit: does the value, its lines (three before, one after) or the folder's README call it a placeholder?"""
    hits = _secret_hits(files)
    readme = (
        files.where(F.rlike("path", F.lit(r"(^|/)README(\.md|\.txt)?$")))
        .where(F.rlike("text", F.lit(PLACEHOLDER_WORDS)))
        .select("repo_id", F.regexp_replace("path", r"[^/]+$", "").alias("_folder"))
        .distinct()
        .withColumn("_documented", F.lit(True))
    )
    first = F.greatest(F.col("line") - 3, F.lit(1))
    nearby = F.array_join(F.slice(split_lines(F.col("text")), first, F.col("line") + 1 - first + 1), "\n")
    told = F.rlike("value", F.lit(PLACEHOLDER_WORDS)) | F.rlike(nearby, F.lit(PLACEHOLDER_WORDS))
    return (
        hits.withColumn("_told", told)
        .withColumn("_folder", F.regexp_replace("path", r"[^/]+$", ""))
        .join(readme, ["repo_id", "_folder"], "left")
        .select(
            "repo_id",
            "path",
            "line",
            "rule_id",
            mask(F.col("value")).alias("masked"),
            (F.col("_told") | F.coalesce("_documented", F.lit(False))).alias("is_placeholder"),
        )
    )


def hits_per_file(hits: DataFrame) -> DataFrame:
    """One finding per rule and file: hit count and the lines of its hits."""
    return hits.groupBy("repo_id", "rule_id", "path").agg(
        F.count("*").alias("hits"),
        F.array_sort(F.collect_list("line")).alias("lines"),
    )


# ------------------------------------------------------------------------- machine-directed text
def injection_signals(
    files: DataFrame, patterns: Sequence[tuple[str, str]] = C.INJECTION_PATTERNS
) -> DataFrame:
    """Lines that address machines, alone or together with the next line.

    A match on the line after a reported line is the same passage and is not reported again.
    """
    lines = F.col("_lines")
    pairs = F.transform(
        lines,
        lambda text, i: F.struct(
            (i + 1).alias("line"),
            text.alias("t"),
            F.when(i + 1 < F.size(lines), F.concat(text, F.lit(" "), F.get(lines, i + 1))).otherwise(text).alias("w"),
        ),
    )

    flat = F.col("_flat")

    def matches(name: str, pattern: str) -> Column:
        # A match inside a line is also one in the line with its successor, unless the pattern asks for the line's end.
        at_end = "$" in pattern

        def hits(x: Column) -> Column:
            both = F.rlike(x["w"], F.lit(pattern))
            return both | F.rlike(x["t"], F.lit(pattern)) if at_end else both

        # Files that match nowhere, line breaks read as blanks, are left after one pass.
        candidates = pairs if at_end else F.when(F.rlike(flat, F.lit(pattern)), pairs)
        return F.transform(
            F.coalesce(F.filter(candidates, hits), F.array().cast(kind)),
            lambda x: F.struct(
                F.lit(name).alias("pattern"), x["line"].alias("line"), strip(x["t"]).alias("excerpt")
            ),
        )

    kind = "array<struct<line:int,t:string,w:string>>"
    matched = F.flatten(F.array(*[matches(name, pattern) for name, pattern in patterns]))
    hits = (
        files.withColumns(
            {"_lines": split_lines(F.col("text")), "_flat": F.regexp_replace("text", LINE_BREAK, " ")}
        )
        .select("repo_id", "path", F.inline(matched))
    )
    by_pattern = Window.partitionBy("repo_id", "path", "pattern").orderBy("line")
    runs = hits.withColumn("_run", F.col("line") - F.row_number().over(by_pattern))
    in_run = Window.partitionBy("repo_id", "path", "pattern", "_run").orderBy("line")
    kept = runs.withColumn("_nth", F.row_number().over(in_run)).where(F.col("_nth") % 2 == 1)
    return kept.select("repo_id", "path", "pattern", "line", "excerpt")


def injection_findings(signals: DataFrame) -> DataFrame:
    """Files worth a finding: documents with any signal, other files with a signal of the two strong kinds."""
    strong = F.col("pattern").isin("exfiltration", "override_instructions")
    document = F.rlike("path", F.lit(r"\.(md|rst|txt|html)$"))
    return (
        signals.groupBy("repo_id", "path")
        .agg(
            F.count("*").alias("signals"),
            F.array_sort(F.collect_set("pattern")).alias("patterns"),
            F.max(strong).alias("_strong"),
        )
        .where(document | F.col("_strong"))
        .drop("_strong")
    )


# --------------------------------------------------------------------------------- duplicated blocks
def duplicate_blocks(files: DataFrame, window: int = DUPLICATE_LINES, min_brackets: int = 2) -> DataFrame:
    """Blocks of normalised lines that occur in two places or more.

    Blank lines, comments and very short lines do not count; a block needs two opening brackets. A block that only
    overlaps itself inside one file is dropped. Only hashes are shuffled, first per file, then per repository.
    """
    normal = F.filter(
        F.transform(
            split_lines(F.col("text")),
            lambda text, i: F.struct((i + 1).alias("line"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t")),
        ),
        lambda x: (F.length(x["t"]) > 3) & ~x["t"].startswith("#"),
    )
    blocks = F.transform(
        F.when(
            F.size("_normal") >= window, F.sequence(F.lit(1), F.size("_normal") - window + 1)
        ).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.get(F.col("_normal"), i - 1)["line"].alias("line"),
            F.array_join(F.transform(F.slice("_normal", i, F.lit(window)), lambda x: x["t"]), "\n").alias("block"),
        ),
    )
    rows = (
        files.withColumn("_normal", normal)
        .select("repo_id", "path", F.inline(blocks))
        .where(F.length("block") - F.length(F.replace("block", F.lit("("), F.lit(""))) >= min_brackets)
        .select("repo_id", "path", "line", F.sha1("block").alias("block_hash"))
    )
    per_file = rows.groupBy("repo_id", "block_hash", "path").agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list("line")).alias("_lines")
    )
    return (
        per_file.groupBy("repo_id", "block_hash")
        .agg(
            F.sum("_n").alias("places"),
            F.count("*").alias("files"),
            F.min(F.struct("path", F.slice("_lines", 1, 2).alias("l"))).alias("_first"),
        )
        .where(F.col("places") >= 2)
        .where(
            (F.col("files") > 1) | (F.get(F.col("_first.l"), F.lit(1)) - F.get(F.col("_first.l"), F.lit(0)) >= window)
        )
        .select(
            "repo_id",
            "block_hash",
            "places",
            "files",
            F.col("_first.path").alias("first_path"),
            F.get(F.col("_first.l"), F.lit(0)).alias("first_line"),
        )
    )


def large_sources(files: DataFrame, more_than: int = 1000) -> DataFrame:
    """Files with more than a thousand line breaks."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.select("repo_id", "path", breaks.alias("line_breaks")).where(F.col("line_breaks") > more_than)


def seed_rows(files: DataFrame, table: str = "ORDERS") -> DataFrame:
    """Rows that SQL seed files insert into a table: bracketed lines between INSERT and the closing semicolon."""
    statement = r"(?is)INSERT\s+INTO[^(]*?" + table + r".*?;\s*(?:\r\n|\r|\n|$)"
    blocks = F.regexp_extract_all("text", F.lit(statement), F.lit(0))
    count = F.aggregate(
        blocks,
        F.lit(0),
        lambda acc, b: acc + F.size(F.filter(F.slice(F.split(b, LINE_BREAK), F.lit(2), F.size(F.split(b, LINE_BREAK))), lambda row: strip(row).startswith("("))),
    )
    return (
        files.where(F.col("path").endswith(".sql"))
        .select("repo_id", count.alias("_rows"))
        .groupBy("repo_id")
        .agg(F.sum("_rows").alias("seed_rows"))
        .where(F.col("seed_rows") > 0)
    )


# ------------------------------------------------------------------------------------------ licenses
def spdx_headers(files: DataFrame) -> DataFrame:
    """The first SPDX header of a file, with its recognised licenses."""
    head = F.transform(
        split_lines(F.col("text")),
        lambda text, i: F.struct((i + 1).alias("line"), spdx_header(text).alias("expression")),
    )
    first = F.get(F.filter(head, lambda x: x["expression"].isNotNull()), F.lit(0))
    return (
        files.where(F.contains("text", F.lit("SPDX-License-Identifier:")))
        .select("repo_id", "path", first.alias("h"))
        .where(F.col("h").isNotNull())
        .select("repo_id", "path", "h.line", "h.expression", normalise_expression(F.col("h.expression")).alias("licenses"))
    )


# ----------------------------------------------------------------------------------------- changelog
def changelog_entries(logs: DataFrame) -> DataFrame:
    """Entries of a changelog text: bullets, headings and paragraphs, with wrapped lines joined. Position from 1."""
    rule = r"^[=~^`-]{3,}$"
    marker = r"^([-*+]|\d+\.)\s"
    heading = r"^(#+\s|[=~^`-]{3,}$)"

    def piece(line: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"^[-*+ ]+", ""), r"^#+", ""))
        return F.when((line != "") & ~F.rlike(line, F.lit(rule)), bare)

    stripped = F.transform(split_lines(F.col("text")), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    numbered = F.transform(
        stripped,
        lambda t, i: F.struct(
            i.alias("line"),
            ((t == "") | F.rlike(t, F.lit(marker)) | F.rlike(t, F.lit(heading))).cast("int").alias("starts"),
            piece(t).alias("piece"),
        ),
    )
    # Entry numbers by a fold inside the row: a list of (entry, words) grows with each line.
    folded = F.aggregate(
        numbered,
        F.struct(F.lit(0).alias("entry"), F.array().cast("array<struct<entry:int,words:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["entry"] + x["starts"]).alias("entry"),
            F.when(
                x["piece"].isNotNull(),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["entry"] + x["starts"]).alias("entry"), x["piece"].alias("words"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    keys = [c for c in logs.columns if c != "text"]
    exploded = logs.select(*keys, F.posexplode(folded["out"]).alias("_pos", "e"))
    grouped = exploded.groupBy(*keys, F.col("e.entry").alias("entry")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "e.words"))), lambda x: x["words"]), " "
        ).alias("text")
    )
    return grouped.where(F.col("text") != "").withColumnRenamed("entry", "position")


def changelog_highlights(old: DataFrame, new: DataFrame) -> DataFrame:
    """New changelog entries about breaking changes, removals, deprecations or security, per library.

    ``old`` and ``new`` are ``(library, text)``. In a library without an old text all entries are new.
    """
    entries = changelog_entries(new)
    seen = changelog_entries(old).select("library", "text").distinct()
    fresh = entries.join(seen, ["library", "text"], "left_anti")
    by_position = Window.partitionBy("library").orderBy("position")
    hits = fresh.where(F.rlike("text", F.lit(C.CHANGELOG_KEYWORDS)) & (F.length("text") > 12))
    return hits.withColumn("rank", F.row_number().over(by_position)).select(
        "library", "rank", clean_markup(F.col("text")).alias("highlight")
    )

"""Landed snapshots: advisories, registries, rule tables, hosting metadata, logs and reports of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.paths import is_test_path
from riskframe.functions.text import split_lines

AFFECTED = (
    "array<struct<package:struct<name:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>"
)
ADVISORY = (
    f"struct<id:string,aliases:array<string>,summary:string,published:string,"
    f"database_specific:struct<severity:string>,affected:{AFFECTED}>"
)
BREAK_RULE = (
    "struct<id:string,package:string,breaking_in:string,call:string,condition:string,keyword:string,"
    "method:string,description:string,fix:string,source:string>"
)
COMMIT_MARK = "@@@"


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """``ecosystem, package, version`` and one record per row; a version without records keeps one row with nulls.

    That row is what tells "looked up, nothing known" from "never looked up".
    """
    raw = spark.read.schema(f"osv map<string,map<string,map<string,array<{ADVISORY}>>>>").json(path, multiLine=True)
    return (
        raw.select(F.explode("osv").alias("ecosystem", "_p"))
        .select("ecosystem", F.explode("_p").alias("package", "_v"))
        .select("ecosystem", "package", F.explode("_v").alias("version", "_r"))
        .select("ecosystem", "package", "version", F.explode_outer("_r").alias("r"))
        .select(
            "ecosystem",
            "package",
            "version",
            "r.id",
            "r.aliases",
            "r.summary",
            "r.published",
            F.col("r.database_specific.severity").alias("severity"),
            "r.affected",
        )
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    entry = "struct<latest_version:string,latest_release_date:string,release_dates:map<string,string>,license:string>"
    raw = spark.read.schema(f"registry map<string,map<string,{entry}>>").json(path, multiLine=True)
    return (
        raw.select(F.explode("registry").alias("ecosystem", "_p"))
        .select("ecosystem", F.explode("_p").alias("package", "e"))
        .select("ecosystem", "package", "e.*")
    )


def read_break_rules(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"rules array<{BREAK_RULE}>").json(path, multiLine=True)
    return raw.select(F.inline("rules"))


def earliest_uploads(releases: DataFrame) -> DataFrame:
    """First upload of each release; ``releases(package, version, upload_time)`` has one row per file."""
    return releases.groupBy("package", "version").agg(F.min("upload_time").alias("released_at"))


def read_commit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Commits and touched files of landed history logs, one file per repository.

    Records start with a mark, then ``sha, author, date, subject`` and one line per file; binary files count as zero.
    """
    raw = spark.read.option("lineSep", COMMIT_MARK).text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("repo_id"), "value"
    )
    return parse_commit_log(raw)


def parse_commit_log(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = split_lines(F.col("value"))
    head = F.split(F.get(rows, F.lit(0)), "\u001f")
    parsed = records.where(F.contains("value", F.lit("\u001f"))).select(
        "repo_id",
        F.get(head, F.lit(0)).alias("sha"),
        F.get(head, F.lit(1)).alias("author"),
        F.try_to_timestamp(F.get(head, F.lit(2))).alias("date"),
        F.coalesce(F.get(head, F.lit(3)), F.lit("")).alias("subject"),
        F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))).alias("_files"),
    ).where(F.col("date").isNotNull())
    fields = F.split("f", "\t")
    count = lambda i: F.coalesce(F.expr(f"try_cast(split(f, '\\t')[{i}] AS INT)"), F.lit(0))
    files = (
        parsed.select("repo_id", "sha", "date", F.explode("_files").alias("f"))
        .where(F.size(fields) == 3)
        .select("repo_id", "sha", "date", F.get(fields, F.lit(2)).alias("path"), count(0).alias("insertions"), count(1).alias("deletions"))
    )
    return parsed.drop("_files"), files


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags newest first; ``library, tag, date`` separated by tabs."""
    tags = spark.read.schema("library string, tag string, date string").csv(path, sep="\t")
    return tags.withColumn("date", F.try_to_timestamp("date")).orderBy(F.col("date").desc())


def read_hosting_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed pages of a hosting platform: ``repository``, ``releases``, ``pulls`` or ``alerts``."""
    schemas = {
        "repository": "repo_id string, archived boolean, open_issues_count long, pushed_at timestamp, "
        "stargazers_count long, forks_count long, default_branch string",
        "releases": "repo_id string, tag_name string, published_at timestamp",
        "pulls": "repo_id string, number long, state string, merged_at timestamp, updated_at timestamp",
        "alerts": "repo_id string, html_url string, dependency struct<package:struct<name:string>>, "
        "security_advisory struct<ghsa_id:string,summary:string,severity:string>",
    }
    return spark.read.schema(schemas[kind]).json(path)


# ------------------------------------------------------------------------------------ tool output
def test_run_counts(logs: DataFrame) -> DataFrame:
    """Counts of the last summary line of each test log: ``run_id, kind, n``."""
    rows = split_lines(F.col("text"))
    is_summary = lambda t: F.rlike(t, F.lit(r"\b(passed|failed|error|errors|no tests ran)\b")) & (
        F.contains(t, F.lit(" in ")) | F.contains(t, F.lit("no tests ran"))
    )
    summary = F.element_at(F.concat(F.array(F.lit("")), F.filter(rows, is_summary)), -1)
    pattern = r"(\d+) (passed|failed|errors?|skipped|xfailed|xpassed|warnings?)"
    numbers = F.regexp_extract_all("_s", F.lit(pattern), F.lit(1))
    kinds = F.regexp_extract_all("_s", F.lit(pattern), F.lit(2))
    kind = F.when(F.col("p.k").isin("error", "errors"), "errors").when(F.col("p.k").isin("warning", "warnings"), "warnings")
    return (
        logs.select("run_id", summary.alias("_s"))
        .select("run_id", F.explode(F.arrays_zip(numbers.alias("n"), kinds.alias("k"))).alias("p"))
        .select("run_id", F.coalesce(kind, F.col("p.k")).alias("kind"), F.col("p.n").cast("int").alias("n"))
        .groupBy("run_id", "kind")
        .agg(F.max("n").alias("n"))
    )


def test_failures(logs: DataFrame) -> DataFrame:
    """Failed tests of each log: ``run_id, kind, node_id, message``."""
    pattern = r"^(FAILED|ERROR) (\S+)(?: - (.*))?$"
    return (
        logs.select("run_id", F.explode(split_lines(F.col("text"))).alias("t"))
        .where(F.rlike("t", F.lit(pattern)))
        .select(
            "run_id",
            F.lower(F.regexp_extract("t", pattern, 1)).alias("kind"),
            F.regexp_extract("t", pattern, 2).alias("node_id"),
            F.regexp_extract("t", pattern, 3).alias("message"),
        )
    )


def coverage_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals per report and percent with missing lines per file; ``reports(repo_id, text)``."""
    summary = "struct<percent_covered:double,covered_lines:int,num_statements:int>"
    schema = f"totals {summary}, files map<string,struct<summary:{summary},missing_lines:array<int>>>"
    doc = reports.select("repo_id", F.from_json("text", schema).alias("d")).where(F.col("d").isNotNull())
    files = (
        doc.select("repo_id", F.explode("d.files").alias("path", "f"))
        .select(
            "repo_id",
            F.replace("path", F.lit("\\"), F.lit("/")).alias("path"),
            "f.summary.*",
            F.col("f.missing_lines").alias("missing_lines"),
        )
    )
    return doc.select("repo_id", "d.totals.*"), files


def low_coverage(totals: DataFrame, medium_below: float = 40, low_below: float = 60) -> DataFrame:
    return totals.where(F.col("percent_covered") < low_below).withColumn(
        "severity", F.when(F.col("percent_covered") < medium_below, F.lit("medium")).otherwise(F.lit("low"))
    )


def benchmark_results(outputs: DataFrame) -> DataFrame:
    """Results of the last output line that is JSON with a ``results`` list; items without a size are dropped."""
    schema = "results array<struct<n:bigint,queries:bigint,seconds:double>>"
    parsed = F.transform(split_lines(F.col("stdout")), lambda t: F.from_json(t, schema))
    good = F.filter(parsed, lambda d: d["results"].isNotNull())
    last = F.element_at(F.concat(F.array(F.lit(None).cast(f"struct<{'results:' + schema[8:]}>")), good), -1)
    return (
        outputs.select("bench_id", F.explode(last["results"]).alias("r"))
        .select("bench_id", "r.*")
        .where(F.coalesce(F.col("n"), F.lit(0)) != 0)
    )


def scanner_results(reports: DataFrame) -> DataFrame:
    """Findings of an external scanner, without those in tests."""
    schema = "results array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<lines:string,message:string>>>"
    rows = reports.select("repo_id", F.posexplode(F.from_json("text", schema)["results"]).alias("position", "r")).select(
        "repo_id",
        "position",
        F.regexp_replace(F.replace(F.col("r.path"), F.lit("\\"), F.lit("/")), r"^[./]+", "").alias("path"),
        F.nullif(F.col("r.start.line"), F.lit(0)).alias("line"),
        F.coalesce("r.check_id", F.lit("scanner")).alias("check_id"),
        F.coalesce("r.extra.lines", F.lit("")).alias("excerpt"),
        F.coalesce("r.extra.message", "r.check_id").alias("message"),
    )
    return rows.where((F.col("path") != "") & ~is_test_path(F.col("path")))


def corroborate(results: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanner results on a line that a security finding reports go to it; the others become findings of their own."""
    security = findings.where(F.col("category") == "security")
    spots = (
        security.select("repo_id", "finding_id", "created_at", F.explode("affected_files").alias("path"), "lines")
        .select("repo_id", "path", "finding_id", "created_at", F.explode("lines").alias("line"))
        .groupBy("repo_id", "path", "line")
        .agg(F.min_by("finding_id", F.struct("created_at", "finding_id")).alias("finding_id"))
    )
    attached = results.join(spots, ["repo_id", "path", "line"])
    return attached, results.join(spots, ["repo_id", "path", "line"], "left_anti")


def scaling_verdict(results: DataFrame) -> DataFrame:
    """Does cost grow with input? By queries per row and query growth, else by time growth; ``bench_id, n, queries, seconds``."""
    first = F.min_by(F.struct("n", "queries", "seconds"), F.struct("n", "queries"))
    last = F.max_by(F.struct("n", "queries", "seconds"), F.struct("n", "queries"))
    per_row = F.min(F.col("queries") / F.greatest(F.lit(1), F.col("n")))
    df = results.groupBy("bench_id").agg(
        F.count("*").alias("points"), first.alias("_f"), last.alias("_l"), per_row.alias("_per_row")
    )
    growth = F.col("_l.n") / F.greatest(F.lit(1), F.col("_f.n"))
    queries = F.col("_l.queries") / F.greatest(F.lit(1), F.col("_f.queries"))
    start = F.coalesce(F.nullif(F.col("_f.seconds"), F.lit(0.0)), F.lit(1e-9))
    seconds = F.coalesce("_l.seconds", F.lit(0.0)) / F.greatest(F.lit(1e-9), start)
    counted = F.col("_f.queries").isNotNull() & F.col("_l.queries").isNotNull()
    confirmed = (
        F.when(F.col("points") < 2, F.lit(False))
        .when(counted, (F.col("_per_row") >= 0.9) & (queries >= 0.8 * growth))
        .otherwise(seconds >= 0.8 * growth)
    )
    return df.select(
        "bench_id",
        "points",
        confirmed.alias("confirmed"),
        growth.alias("input_growth"),
        F.when(counted, queries).alias("query_growth"),
        F.when(~counted, seconds).alias("time_growth"),
    )

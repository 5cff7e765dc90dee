"""Repository files and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import paths
from riskframe.functions.text import split_lines

SOURCE_SUFFIXES = [
    "py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "java", "go", "rs", "rb", "php", "cs", "c", "h", "cpp", "hpp", "kt",
    "swift", "scala", "sql", "sh",
]


def read_repository_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Text files under ``root/<repository>/…``: no vendored folders, no binaries, within a size limit if one is given."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    named = raw.select(
        F.split_part(relative, F.lit("/"), F.lit(1)).alias("repo_id"),
        F.regexp_replace(relative, "^[^/]+/", "").alias("path"),
        F.col("length").alias("size"),
        "content",
    )
    return text_files(named.where(paths.is_scannable(F.col("path"), F.col("size"), max_bytes)))


def text_files(blobs: DataFrame) -> DataFrame:
    """Decode blobs that are text: no zero byte among the first 8 KiB. Broken UTF-8 is replaced."""
    head = F.hex(F.expr("substring(content, 1, 8192)"))
    has_zero = F.rlike(head, F.lit(r"^(?:..)*?00"))
    return blobs.where(~has_zero).select(
        "repo_id", "path", "size", F.decode("content", F.lit("UTF-8")).alias("text")
    )


def project_tree(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Source files and manifests of a project, without hidden or vendored folders."""
    path = F.col("path")
    manifest = paths.ecosystem_of_manifest(path).isNotNull() | (paths.file_name(path) == "package-lock.json")
    hidden = F.rlike(path, F.lit(r"(^|/)\.[^/]*/"))
    wanted = F.coalesce(paths.suffix(path).isin(SOURCE_SUFFIXES), F.lit(False)) | manifest
    size = F.octet_length("text")
    return files.where(wanted & ~hidden & paths.is_scannable(path, size, max_bytes))


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in files.columns if c != "text"]
    return files.select(*keep, F.posexplode(split_lines(F.col("text"))).alias("_pos", "line_text")).select(
        *keep, (F.col("_pos") + 1).alias("line"), "line_text"
    )


def line_range(lined: DataFrame, start: int, end: int) -> DataFrame:
    return lined.where(F.col("line").between(max(1, start), max(start, end)))


def with_path_facts(files: DataFrame) -> DataFrame:
    """Path class, language and components of every file."""
    path = F.col("path")
    return files.withColumns(
        {
            "is_test": paths.is_test_path(path),
            "is_fixture": paths.is_fixture_path(path),
            "language": paths.language(path),
            "components": paths.components(path),
            "ecosystem": paths.ecosystem_of_manifest(path),
        }
    )


def repository_profile(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """One row per repository: sizes, languages, tests, packages, entry points, signals of databases and the network.

    Languages and packages are counted before they reach the per-repository step; lists are cut where the profile is.
    """
    path = F.col("path")
    language = paths.language(path)
    test = paths.is_test_path(path)
    script = F.coalesce(paths.suffix(path).isin("py", "js", "ts"), F.lit(False))
    database = script & F.rlike("text", F.lit(r"\b(sqlite3|sqlalchemy|psycopg|pymysql|django\.db|\.execute\(|SELECT\s)"))
    network = script & F.rlike("text", F.lit(r"\b(requests\.(get|post|put)|httpx\.|fetch\(|axios\.)"))
    test_suffix = F.coalesce(paths.suffix(path).isin("py", "js", "ts", "tsx", "go", "java", "rs"), F.lit(False))
    package = F.when(F.rlike(path, F.lit(r"^[^/]+/__init__\.py$")) & ~test, F.split_part(path, F.lit("/"), F.lit(1))).when(
        F.rlike(path, F.lit(r"^src/[^/]+/__init__\.py$")), F.split_part(path, F.lit("/"), F.lit(2))
    )
    bench = path.endswith(".py") & (F.contains(F.lower(path), F.lit("bench")) | path.startswith("perf/"))
    license_file = F.rlike(F.upper(paths.file_name(path)), F.lit("^(LICENSE|LICENCE|COPYING)"))
    facts = files.select(
        "repo_id",
        language.alias("language"),
        (test & test_suffix).alias("is_test_file"),
        (language.isNotNull() & ~test).alias("is_source"),
        package.alias("package"),
        paths.is_entrypoint(path).alias("is_entry"),
        bench.alias("is_bench"),
        license_file.alias("is_license"),
        database.alias("database"),
        network.alias("network"),
        paths.ecosystem_of_manifest(path).alias("ecosystem"),
        F.octet_length("text").alias("bytes"),
    )
    profile = facts.groupBy("repo_id").agg(
        F.count("*").alias("file_count"),
        F.sum("bytes").alias("total_bytes"),
        F.count_if("is_source").alias("source_file_count"),
        F.count_if("is_test_file").alias("test_file_count"),
        F.count_if("is_entry").alias("entrypoint_count"),
        F.count_if("is_bench").alias("benchmark_count"),
        F.max("is_license").alias("has_license_file"),
        F.max("database").alias("uses_database"),
        F.max("network").alias("uses_network_calls"),
        F.array_sort(F.collect_set("ecosystem")).alias("ecosystems"),
        F.array_sort(F.collect_set("package")).alias("python_packages"),
    )
    languages = facts.where(F.col("language").isNotNull()).groupBy("repo_id", "language").agg(F.count("*").alias("n"))
    primary = languages.groupBy("repo_id").agg(
        F.max_by("language", F.struct(F.col("n"), F.col("language"))).alias("primary_language"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"),
    )
    out = profile.join(primary, "repo_id", "left")
    if commits is None:
        return out.withColumn("git_commits", F.lit(0).cast("bigint"))
    history = commits.groupBy("repo_id").agg(F.count("*").alias("git_commits"))
    return out.join(history, "repo_id", "left").na.fill(0, ["git_commits"])

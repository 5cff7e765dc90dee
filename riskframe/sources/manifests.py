"""Dependency manifests as table jobs: each format is a filter on paths and a few expressions on lines or text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import paths
from riskframe.functions.text import split_lines, strip
from riskframe.session import cut_lineage
from riskframe.sources.files import lines

REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*(\(?[^;#]*\)?)?\s*(;.*)?$"
EXACT_PYTHON = r"^===?\s*([A-Za-z0-9.+!_-]+)$"
EXACT_SEMVER = r"^=?v?(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?)$"
COLUMNS = "repo_id name display_name ecosystem spec version pinned manifest line dev resolved_from".split()


def _null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def python_requirement(raw: Column) -> Column:
    """Struct ``name, spec, version`` of a requirement text; null on comments, options, addresses and paths."""
    trimmed = strip(raw)
    bare = strip(F.regexp_replace(trimmed, r" #.*$", ""))
    skipped = (trimmed == "") | F.rlike(trimmed, F.lit(r"^(#|-|git\+|http:|https:|file:|\.)"))
    spec = F.replace(
        F.regexp_replace(strip(F.regexp_extract(bare, REQUIREMENT, 3)), r"^[()]+|[()]+$", ""), F.lit(" "), F.lit("")
    )
    exact = _null_if_empty(F.regexp_extract(spec, EXACT_PYTHON, 1))
    return F.when(
        ~skipped & F.rlike(bare, F.lit(REQUIREMENT)),
        F.struct(
            F.regexp_extract(bare, REQUIREMENT, 1).alias("name"),
            F.when(spec == "", F.lit("*")).otherwise(spec).alias("spec"),
            F.when(~F.contains(exact, F.lit("*")), exact).alias("version"),
        ),
    )


def _dependencies(df: DataFrame, ecosystem: str, name: Column, spec: Column, version: Column, dev: Column, line: Column | None = None, pinned: Column | None = None, resolved: Column | None = None) -> DataFrame:
    return df.select(
        "repo_id",
        paths.normalise_package(name, F.lit(ecosystem)).alias("name"),
        name.alias("display_name"),
        F.lit(ecosystem).alias("ecosystem"),
        spec.alias("spec"),
        version.alias("version"),
        (pinned if pinned is not None else version.isNotNull()).alias("pinned"),
        F.col("path").alias("manifest"),
        (line if line is not None else F.col("line")).cast("int").alias("line"),
        dev.alias("dev"),
        (resolved if resolved is not None else F.lit(None).cast("string")).alias("resolved_from"),
    )


def included_requirements(files: DataFrame) -> DataFrame:
    """Requirement files and what they include, each file once: ``repo_id, path``."""
    texts = files.select("repo_id", "path", "text")
    known = cut_lineage(
        texts.where(paths.is_requirements_file(F.col("path"))).select("repo_id", "path").distinct()
    )
    frontier = known
    while not frontier.isEmpty():
        inside = texts.join(frontier, ["repo_id", "path"], "left_semi")
        include = F.regexp_extract(strip(F.col("line_text")), r"^(?:-r|--requirement)\s+(\S.*)$", 1)
        folder = F.regexp_replace("path", r"[^/]+$", "")
        targets = (
            lines(inside)
            .where(F.rlike(strip(F.col("line_text")), F.lit(r"^(-r|--requirement) ")))
            .select("repo_id", F.regexp_replace(F.concat(folder, strip(include)), r"(^|/)\./", "$1").alias("path"))
            .where(~F.rlike("path", F.lit(r"(^|/)\.\.(/|$)")))
            .distinct()
        )
        frontier = cut_lineage(
            targets.join(texts.select("repo_id", "path"), ["repo_id", "path"], "left_semi").join(known, ["repo_id", "path"], "left_anti")
        )
        known = cut_lineage(known.unionByName(frontier))
    return known


def requirement_files(files: DataFrame) -> DataFrame:
    """Dependencies of requirement files, includes followed; a file with dev or test in its name is a dev file."""
    chosen = files.join(included_requirements(files), ["repo_id", "path"], "left_semi")
    parsed = lines(chosen.select("repo_id", "path", "text")).withColumn("_r", python_requirement(F.col("line_text")))
    dev = F.rlike(paths.file_name(F.col("path")), F.lit("dev|test"))
    return _dependencies(
        parsed.where(F.col("_r").isNotNull()), "PyPI", F.col("_r.name"), F.col("_r.spec"), F.col("_r.version"), dev
    )


def _sectioned(files: DataFrame) -> DataFrame:
    """Lines with the section they are in and the key they belong to, both carried forward inside the file."""
    header = _null_if_empty(F.regexp_extract("line_text", r"^\s*\[+([^\]]+)\]+\s*(#.*)?$", 1))
    key = F.coalesce(
        _null_if_empty(F.regexp_extract("line_text", r"^\s*\"([^\"]+)\"\s*=[^=]", 1)),
        _null_if_empty(F.regexp_extract("line_text", r"^\s*([A-Za-z0-9_.-]+)\s*=[^=]", 1)),
        F.when(header.isNotNull(), F.lit("")),
    )
    down = Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines(files.select("repo_id", "path", "text"))
        .withColumn("section", strip(F.last(header, ignorenulls=True).over(down)))
        .withColumn("key", F.last(key, ignorenulls=True).over(down))
        .withColumn("_starts", F.coalesce(key != "", F.lit(False)))
        .where(header.isNull())
    )


def _table_spec() -> Column:
    """The version text of ``name = "spec"`` or ``name = { version = "spec" }``; any version when neither is given."""
    line = F.col("line_text")
    inline_version = _null_if_empty(F.regexp_extract(line, r"version\s*=\s*[\"']([^\"']*)[\"']", 1))
    plain = _null_if_empty(F.regexp_extract(line, r"=\s*[\"']([^\"']*)[\"']", 1))
    return F.coalesce(F.when(F.rlike(line, F.lit(r"=\s*\{")), F.coalesce(inline_version, F.lit("*"))), plain, F.lit("*"))


def pyproject_files(files: DataFrame) -> DataFrame:
    """Project, optional and poetry dependencies of ``pyproject.toml``; arrays may span lines."""
    rows = _sectioned(files.where(paths.file_name(F.col("path")) == "pyproject.toml"))
    listed = rows.where(
        ((F.col("section") == "project") & (F.col("key") == "dependencies"))
        | (F.col("section") == "project.optional-dependencies")
    )
    body = F.when(F.col("_starts"), F.regexp_replace("line_text", r"^[^=]*=", "")).otherwise(F.col("line_text"))
    quoted = F.regexp_extract_all(body, F.lit(r"\"([^\"]+)\"|'([^']+)'"), F.lit(0))
    bare = F.transform(quoted, lambda q: F.regexp_replace(q, r"^[\"']|[\"']$", ""))
    items = listed.withColumn("_raw", F.explode(bare)).withColumn("_r", python_requirement(F.col("_raw")))
    dev = (F.col("section") == "project.optional-dependencies") & F.col("key").isin("dev", "test", "tests", "lint")
    from_lists = _dependencies(
        items.where(F.col("_r").isNotNull()), "PyPI", F.col("_r.name"), F.col("_r.spec"), F.col("_r.version"), dev
    )
    poetry = rows.where(
        F.col("section").isin("tool.poetry.dependencies", "tool.poetry.dev-dependencies")
        & F.col("_starts")
        & (F.lower("key") != "python")
    ).withColumn("_spec", _table_spec())
    exact = _null_if_empty(F.regexp_extract(strip(F.col("_spec")), r"^=?=?(\d+(?:\.\d+)*)$", 1))
    from_tables = _dependencies(
        poetry, "PyPI", F.col("key"), F.col("_spec"), exact, F.col("section") == "tool.poetry.dev-dependencies"
    )
    return from_lists.unionByName(from_tables)


def pipfiles(files: DataFrame) -> DataFrame:
    rows = _sectioned(files.where(paths.file_name(F.col("path")) == "Pipfile"))
    listed = rows.where(F.col("section").isin("packages", "dev-packages") & F.col("_starts")).withColumn("_spec", _table_spec())
    exact = _null_if_empty(F.regexp_extract(F.replace("_spec", F.lit(" "), F.lit("")), EXACT_PYTHON, 1))
    return _dependencies(listed, "PyPI", F.col("key"), F.col("_spec"), exact, F.col("section") == "dev-packages")


def cargo_files(files: DataFrame) -> DataFrame:
    rows = _sectioned(files.where(paths.file_name(F.col("path")) == "Cargo.toml"))
    listed = rows.where(F.col("section").isin("dependencies", "dev-dependencies") & F.col("_starts")).withColumn("_spec", _table_spec())
    exact = _null_if_empty(F.regexp_extract(strip(F.col("_spec")), r"^=\s*(\d+\.\d+\.\d+)$", 1))
    return _dependencies(listed, "crates.io", F.col("key"), F.col("_spec"), exact, F.col("section") == "dev-dependencies")


def npm_manifests(files: DataFrame) -> DataFrame:
    """Dependencies of ``package.json``: an exact spec pins, else the lock file beside it resolves the version."""
    chosen = files.where((paths.file_name(F.col("path")) == "package.json") & ~F.contains("path", F.lit("node_modules")))
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    doc = chosen.select("repo_id", "path", "text", F.from_json("text", schema).alias("d"))
    empty = F.lit(None).cast("map<string,string>")
    declared = doc.select(
        "repo_id", "path", "text", F.coalesce("d.dependencies", empty).alias("m"), F.lit(False).alias("dev")
    ).unionByName(
        doc.select("repo_id", "path", "text", F.coalesce("d.devDependencies", empty).alias("m"), F.lit(True).alias("dev"))
    )
    rows = declared.select("repo_id", "path", "text", "dev", F.explode("m").alias("name", "spec"))
    locks = files.where(paths.file_name(F.col("path")) == "package-lock.json")
    lock_schema = "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>"
    lock = locks.select(
        "repo_id", F.regexp_replace("path", r"[^/]+$", "").alias("_folder"), F.from_json("text", lock_schema).alias("l")
    )
    in_packages = lock.select("repo_id", "_folder", F.explode("l.packages").alias("_p", "_v")).where(
        F.col("_p").startswith("node_modules/")
    ).select("repo_id", "_folder", F.regexp_replace("_p", "^node_modules/", "").alias("name"), F.col("_v.version").alias("_lock"), F.lit(0).alias("_o"))
    in_tree = lock.select("repo_id", "_folder", F.explode("l.dependencies").alias("name", "_v")).select(
        "repo_id", "_folder", "name", F.col("_v.version").alias("_lock"), F.lit(1).alias("_o")
    )
    locked = (
        in_packages.unionByName(in_tree)
        .where(F.col("_lock").isNotNull())
        .groupBy("repo_id", "_folder", "name")
        .agg(F.min_by("_lock", "_o").alias("_lock"))
    )
    exact = _null_if_empty(F.regexp_extract(strip(F.col("spec")), EXACT_SEMVER, 1))
    joined = rows.withColumn("_folder", F.regexp_replace("path", r"[^/]+$", "")).join(
        locked, ["repo_id", "_folder", "name"], "left"
    )
    version = F.coalesce(exact, F.col("_lock"))
    line = F.array_position(
        F.transform(split_lines(F.col("text")), lambda t: F.contains(t, F.concat(F.lit('"'), F.col("name"), F.lit('"')))), True
    )
    return _dependencies(
        joined,
        "npm",
        F.col("name"),
        F.col("spec"),
        version,
        F.col("dev"),
        line,
        exact.isNotNull(),
        F.when(exact.isNull() & F.col("_lock").isNotNull(), F.lit("package-lock.json")),
    )


def go_modules(files: DataFrame) -> DataFrame:
    """``require`` lines and blocks of ``go.mod``; indirect modules count as dev."""
    rows = lines(files.where(paths.file_name(F.col("path")) == "go.mod").select("repo_id", "path", "text"))
    code = strip(F.regexp_replace("line_text", r"//.*$", ""))
    state = F.when(code.startswith("require ("), F.lit(1)).when(code == ")", F.lit(0))
    down = Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    tracked = rows.withColumn("_open", F.coalesce(F.last(state, ignorenulls=True).over(down), F.lit(0))).withColumn("_code", code)
    pattern = r"^(?:require\s+)?(\S+)\s+(v\S+)"
    wanted = tracked.where(
        F.rlike("_code", F.lit(pattern))
        & (((F.col("_open") == 1) & ~F.col("_code").startswith("require (")) | F.rlike("_code", F.lit(r"^require\s+\S+\s+v")))
    )
    version = F.regexp_extract("_code", pattern, 2)
    return _dependencies(
        wanted, "Go", F.regexp_extract("_code", pattern, 1), version, version, F.contains("line_text", F.lit("// indirect"))
    )


def maven_files(files: DataFrame) -> DataFrame:
    """``<dependency>`` blocks of ``pom.xml``; a property as version is no version."""
    chosen = files.where(paths.file_name(F.col("path")) == "pom.xml")
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    rows = chosen.select("repo_id", "path", "text", F.explode(blocks).alias("_b"))

    def tag(name: str) -> Column:
        return _null_if_empty(F.regexp_extract("_b", rf"<{name}>\s*([^<\s]+)\s*</{name}>", 1))

    named = rows.withColumns({"_g": tag("groupId"), "_a": tag("artifactId"), "_v": tag("version"), "_s": tag("scope")})
    before = F.split_part("text", F.col("_b"), F.lit(1))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    version = F.when(~F.contains("_v", F.lit("${")), F.col("_v"))
    return _dependencies(
        named.where(F.col("_g").isNotNull() & F.col("_a").isNotNull()),
        "Maven",
        F.concat_ws(":", "_g", "_a"),
        F.coalesce("_v", F.lit("*")),
        version,
        F.coalesce(F.col("_s") == "test", F.lit(False)),
        line,
    )


def gradle_files(files: DataFrame) -> DataFrame:
    chosen = files.where(paths.file_name(F.col("path")).isin("build.gradle", "build.gradle.kts"))
    pattern = r"(implementation|api|compile|runtimeOnly|testImplementation)\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+):([^'\"]+)['\"]"
    rows = lines(chosen.select("repo_id", "path", "text")).where(F.rlike("line_text", F.lit(pattern)))

    def part(n: int) -> Column:
        return F.regexp_extract("line_text", pattern, n)

    version = F.when(~F.rlike(part(4), F.lit(r"[$+]")), part(4))
    return _dependencies(rows, "Maven", F.concat_ws(":", part(2), part(3)), part(4), version, part(1).startswith("test"))


def all_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of every manifest, the first of each ecosystem, name and manifest."""
    parts = [
        requirement_files(files),
        *[read(files) for read in (pyproject_files, pipfiles, npm_manifests, go_modules, cargo_files, maven_files, gradle_files)],
    ]
    every = reduce(DataFrame.unionByName, parts)
    keys = ["repo_id", "ecosystem", "name", "manifest"]
    rest = [c for c in COLUMNS if c not in keys]
    return (
        every.groupBy(*keys)
        .agg(F.min(F.struct(F.coalesce("line", F.lit(2**30)).alias("_at"), *rest)).alias("_d"))
        .select(*keys, "_d.*")
        .select(*COLUMNS)
    )


def version_floor(spec: Column, version: Column) -> Column:
    """The lowest version a spec allows: the exact pin, or the bound of ``>=``, ``~=``, ``^`` or ``>``."""
    return F.coalesce(version, _null_if_empty(F.regexp_extract(spec, r"(?:>=|~=|\^|>)\s*([0-9][^,;\s]*)", 1)))


def project_pins(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """The version each project asks of a package: the first manifest by path; ``packages(name, ecosystem)``."""
    wanted = packages.select(paths.normalise_package(F.col("name"), F.col("ecosystem")).alias("name"), "ecosystem")
    return (
        deps.join(wanted, ["name", "ecosystem"], "left_semi")
        .groupBy("repo_id", "ecosystem", "name")
        .agg(F.min_by(F.struct("manifest", "line", "spec", "version"), F.struct("manifest", "line")).alias("_p"))
        .select("repo_id", "ecosystem", "name", "_p.*")
        .withColumn("floor", version_floor(F.col("spec"), F.col("version")))
    )


def tag_of_version(versions: DataFrame, tags: DataFrame) -> DataFrame:
    """The tag of a version, by spelling in order of preference, whatever its case.

    ``versions(library, version, package)``, ``tags(library, tag)``.
    """
    v, p = F.col("version"), F.col("package")
    spellings = F.array_compact(
        F.array(
            v,
            F.concat(F.lit("v"), v),
            F.concat(p, F.lit("-"), v),
            F.concat(p, F.lit("@"), v),
            F.concat(p, F.lit("-v"), v),
            F.concat(F.lit("release-"), v),
            F.concat(F.lit("rel-"), v),
            F.concat(F.lit("version-"), v),
        )
    )
    wanted = versions.select("library", "version", "package", F.posexplode(spellings).alias("_rank", "_t"))
    lower = tags.select("library", F.lower("tag").alias("_t"), "tag")
    return (
        wanted.withColumn("_t", F.lower("_t"))
        .join(lower, ["library", "_t"])
        .groupBy("library", "version")
        .agg(F.min_by("tag", F.struct("_rank", "tag")).alias("tag"))
    )

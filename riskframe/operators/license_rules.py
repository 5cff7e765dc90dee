"""License rules of repositories: no license, contradicting metadata, files and dependencies under conflicting terms.

License expressions are evaluated as trees. An expression is cut into names, operators and parentheses, each name becomes the rank of its
conflict with the project, and one pass with a stack of values and a stack of operators reduces the tree: a choice (OR) is as
bad as its best option, a conjunction (AND) as bad as its worst part, and names nobody recognises have no say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.licenses import conflict_severity, license_class, normalise_license, with_license_of_text
from riskframe.operators.textscan import spdx_headers

SEVERITIES = ("info", "low", "medium", "high", "critical")
UNKNOWN = -1
_TOKEN = r"[()]|\b(?:OR|AND)\b|[/,]|(?:(?!\b(?:OR|AND)\b)[^()/,])+"
_STATE = "struct<vals: array<int>, ops: array<string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reduced(state: Column, least: int) -> Column:
    """The state after its top operator is applied, if that binds as strongly as ``least`` (2: AND, 1: OR)."""
    top, n = F.get(state["ops"], F.size(state["ops"]) - 1), F.size(state["vals"])
    right, left = F.get(state["vals"], n - 1), F.get(state["vals"], n - 2)
    best = F.when(left == UNKNOWN, right).when(right == UNKNOWN, left).otherwise(F.least(left, right))
    value = F.when(top == "AND", F.greatest(left, right)).otherwise(best)
    applied = F.struct(
        F.concat(F.slice(state["vals"], 1, n - 2), F.array(value)).alias("vals"),
        F.slice(state["ops"], 1, F.size(state["ops"]) - 1).alias("ops"),
    ).cast(_STATE)
    strength = F.when(top == "AND", 2).when(top == "OR", 1).otherwise(0)
    return F.when((F.size(state["ops"]) > 0) & (n > 1) & (strength >= least), applied).otherwise(state)


def _reduce_all(state: Column, least: int) -> Column:
    """At most an AND above an OR wait within one pair of parentheses, so two steps are enough."""
    return F.aggregate(F.array(F.lit(1), F.lit(2)), state, lambda s, _: _reduced(s, least))


def expression_conflict(project: Column, expression: Column) -> Column:
    """Severity of the conflict between a project's license and a license expression as a tree; null without one.

    Commas and slashes are choices. AND binds more strongly than OR. Parentheses that are never closed close at the end, others
    are skipped. Null and empty expressions, and those of unknown names only, do not conflict.
    """
    tokens = F.filter(F.transform(F.regexp_extract_all(expression, F.lit(_TOKEN), F.lit(0)), lambda t: F.trim(t)), lambda t: t != "")
    ranks = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])

    def kinds(token: Column) -> Column:
        kind = F.when(token.isin("(", ")"), token).when(token == "AND", "AND").when(token.isin("OR", "/", ","), "OR").otherwise("name")
        def rank(known: Column) -> Column:
            return F.when(known.isNull(), UNKNOWN).otherwise(F.coalesce(F.try_element_at(ranks, conflict_severity(project, known)), F.lit(0)))

        return F.struct(kind.alias("kind"), F.when(kind == "name", _let(normalise_license(token), rank)).alias("rank"))

    def push(state: Column, op: Column) -> Column:
        return F.struct(state["vals"].alias("vals"), F.array_append(state["ops"], op).alias("ops")).cast(_STATE)

    def turn(state: Column, token: Column) -> Column:
        def popped(closed: Column) -> Column:
            n = F.size(closed["ops"])
            opened = F.coalesce(F.get(closed["ops"], n - 1) == "(", F.lit(False))
            rest = F.when(opened, F.slice(closed["ops"], 1, n - 1)).otherwise(closed["ops"])
            return F.struct(closed["vals"].alias("vals"), rest.alias("ops")).cast(_STATE)

        named = F.struct(F.array_append(state["vals"], token["rank"]).alias("vals"), state["ops"].alias("ops")).cast(_STATE)
        return (
            F.when(token["kind"] == "name", named)
            .when(token["kind"] == "(", push(state, F.lit("(")))
            .when(token["kind"] == ")", _let(_reduce_all(state, 1), popped))
            .when(token["kind"] == "AND", push(_reduce_all(state, 2), F.lit("AND")))
            .otherwise(push(_reduce_all(state, 1), F.lit("OR")))
        )

    empty = F.struct(F.array().cast("array<int>").alias("vals"), F.array().cast("array<string>").alias("ops")).cast(_STATE)
    names = F.array(*[F.lit(s) for s in SEVERITIES])

    def finish(done: Column) -> Column:
        """What still waits when an opening parenthesis never closed: those go, and the rest is reduced from the right."""
        left = F.struct(done["vals"].alias("vals"), F.filter(done["ops"], lambda o: o != "(").alias("ops")).cast(_STATE)
        whole = F.aggregate(done["ops"], left, lambda s, _: _reduced(s, 1))
        return _let(F.get(_let(whole, lambda w: F.slice(w["vals"], F.greatest(F.size(w["vals"]), F.lit(1)), F.lit(1))), F.lit(0)), lambda r: F.when(r > 0, F.get(names, r)))

    return F.aggregate(F.transform(tokens, kinds), empty, turn, finish)


def license_files(files: DataFrame) -> DataFrame:
    """License files at the root of repositories ``(repo_id, path, text)``, with the license their text is, if recognised."""
    stem = F.upper(F.split_part("path", F.lit("."), F.lit(1)))
    return with_license_of_text(files.where(~F.contains("path", F.lit("/")) & stem.isin("LICENSE", "LICENCE", "COPYING"))).select("repo_id", "path", "license_id")


def declared_licenses(files: DataFrame) -> DataFrame:
    """Licenses that root manifests state: repo_id, manifest, rank, declared (canonical, null if unknown), value."""
    of_table = r'(?s)(?:^|\n)\s*\[{}\](?:(?!\n\s*\[).)*?\n\s*license\s*=\s*(?:"([^"]*)"|\'([^\']*)\'|\{{[^}}\n]*?(?:text|file)\s*=\s*["\']([^"\']*)["\'])'

    def of(section: str) -> Column:
        parts = [F.nullif(F.regexp_extract("text", of_table.format(section), i), F.lit("")) for i in (1, 2, 3)]
        return F.coalesce(*parts)

    npm = F.get_json_object("text", "$.license")
    value = (
        F.when(F.col("path") == "pyproject.toml", of("project"))
        .when(F.col("path") == "package.json", F.when(~F.rlike(npm, F.lit(r"^[\[{]")), npm))
        .when(F.col("path") == "Cargo.toml", of("package"))
    )
    rank = F.when(F.col("path") == "pyproject.toml", 0).when(F.col("path") == "package.json", 1).otherwise(2)
    rows = files.where(F.col("path").isin("pyproject.toml", "package.json", "Cargo.toml")).select("repo_id", F.col("path").alias("manifest"), rank.alias("rank"), value.alias("value"))
    return rows.where("value is not null").withColumn("declared", normalise_license(F.col("value")))


def project_licenses(files: DataFrame) -> DataFrame:
    """The license of each repository that states one: repo_id, license_id, license_file (null if a manifest states it)."""
    recognised = license_files(files).where("license_id is not null").select("repo_id", F.struct(F.lit(0).alias("r"), "path").alias("at"), "license_id")
    stated = declared_licenses(files).where("declared is not null").select(
        "repo_id", F.struct((F.col("rank") + 1).alias("r"), F.lit(None).cast("string").alias("path")).alias("at"), F.col("declared").alias("license_id")
    )
    best = recognised.unionByName(stated).groupBy("repo_id").agg(F.min_by(F.struct("license_id", F.col("at.path").alias("license_file")), "at").alias("_b"))
    return best.select("repo_id", "_b.license_id", "_b.license_file")


def _finding(rule: str, subject: Column, severity: Column, files: Column, detail: Column) -> list[Column]:
    return [
        "repo_id",
        F.lit(rule).alias("rule_id"),
        subject.alias("subject"),
        severity.alias("severity"),
        files.alias("affected_files"),
        detail.alias("detail"),
    ]


def license_findings(repositories: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """All license findings: repo_id, rule_id, subject, severity, affected_files (sorted), detail.

    ``repositories(repo_id)`` are all there are, so that one without any file is missing its license too; ``files(repo_id, path,
    text)``; ``dependencies(repo_id, name, manifest, registry_status, registry_license)``. Rules: ``license.missing``,
    ``license.metadata_mismatch``, ``license.copyleft_file``, ``license.dependency_incompatible``. A repository without a known
    license has no conflicts. Nulls conflict with nothing; repeated rows count once.
    """
    projects = project_licenses(files)
    project = F.lit("license:project")
    held = license_files(files)
    missing = repositories.select("repo_id").distinct().join(held, "repo_id", "left_anti").select(
        *_finding("license.missing", project, F.lit("medium"), F.array().cast("array<string>"), F.lit("no license file at the root"))
    )
    mismatch = (
        declared_licenses(files)
        .join(projects, "repo_id")
        .where(F.col("declared") != F.col("license_id"))
        .distinct()
        .select(
            *_finding(
                "license.metadata_mismatch",
                project,
                F.lit("medium"),
                F.array_sort(F.array("manifest", F.coalesce("license_file", F.lit("LICENSE")))),
                F.concat("manifest", F.lit(" declares "), "declared", F.lit(", project is "), "license_id"),
            )
        )
    )
    headers = spdx_headers(files.where(F.rlike("path", F.lit(r"\.(py|js|ts|go|rs|java|c|h|cpp)$"))))
    named = F.when(F.size("licenses") > 0, F.col("licenses")).otherwise(F.array(F.trim("expression")))
    copyleft = (
        headers.select("repo_id", "path", F.explode(named).alias("file_license"))
        .join(projects, "repo_id")
        .withColumn("severity", conflict_severity(F.col("license_id"), F.col("file_license")))
        .where("severity is not null")
        .groupBy("repo_id", "file_license", "license_id", "severity")
        .agg(F.array_sort(F.collect_set("path")).alias("paths"))
        .select(
            *_finding(
                "license.copyleft_file",
                F.concat(F.lit("license-file:"), "file_license"),
                F.col("severity"),
                F.col("paths"),
                F.concat("file_license", F.lit(" ("), license_class(F.col("file_license")), F.lit(") in a "), "license_id", F.lit(" project")),
            )
        )
    )
    incompatible = (
        dependencies.where(F.col("registry_status") == "ok")
        .select("repo_id", "name", "manifest", "registry_license")
        .distinct()
        .join(projects, "repo_id")
        .withColumn("severity", expression_conflict(F.col("license_id"), F.col("registry_license")))
        .where("severity is not null")
        .select(
            *_finding(
                "license.dependency_incompatible",
                F.concat(F.lit("pkg:"), "name"),
                F.col("severity"),
                F.array("manifest"),
                F.concat("registry_license", F.lit(" in a "), "license_id", F.lit(" project")),
            )
        )
    )
    return missing.unionByName(mismatch).unionByName(copyleft).unionByName(incompatible)

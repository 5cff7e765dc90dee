"""Dependency health: advisories, freshness, pinning, conflicting specs, usage, license compatibility, upgrades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.licenses import conflict_severity, normalise_expression
from riskframe.functions.lookup import advisory_rank, lookup
from riskframe.functions.paths import is_test_path
from riskframe.functions.versions import age_days, version_gap, version_key
from riskframe.operators.graph import connected_groups
from riskframe.session import stage


def advisory_status(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Look every dependency up: ``ok``, ``unavailable``, ``unpinned`` or ``unsupported``. Absence is never "clean"."""
    known = (
        advisories.groupBy("ecosystem", F.col("package").alias("name"), "version")
        .agg(F.count("id").alias("records"))
    )
    status = (
        F.when(~F.col("ecosystem").isin(*C.ADVISORY_ECOSYSTEMS), F.lit("unsupported"))
        .when(F.col("version").isNull(), F.lit("unpinned"))
        .when(F.col("records").isNull(), F.lit("unavailable"))
        .otherwise(F.lit("ok"))
    )
    return deps.join(known, ["ecosystem", "name", "version"], "left").withColumn("advisory_status", status)


def registry_status(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry facts of every dependency, with the release date of its own version."""
    facts = registry.select(
        "ecosystem",
        F.col("package").alias("name"),
        "latest_version",
        "latest_release_date",
        "release_dates",
        F.col("license").alias("registry_license"),
        F.lit(True).alias("_known"),
    )
    status = (
        F.when(~F.col("ecosystem").isin(*C.REGISTRY_ECOSYSTEMS), F.lit("unsupported"))
        .when(F.col("_known").isNull(), F.lit("unavailable"))
        .otherwise(F.lit("ok"))
    )
    return (
        deps.join(facts, ["ecosystem", "name"], "left")
        .withColumn("registry_status", status)
        .withColumn("pinned_release_date", F.try_element_at("release_dates", F.col("version")))
        .drop("_known", "release_dates")
    )


def advisory_groups(advisories: DataFrame) -> DataFrame:
    """Records that share an identifier describe one vulnerability: severity, aliases and fixes per group.

    The record with a severity speaks for its group, then the one of the curated database.
    """
    keys = ["ecosystem", "package", "version"]
    records = advisories.where(F.col("id").isNotNull())
    scope = F.concat_ws("\u001f", *keys)
    edges = records.select(
        scope.alias("_scope"), "id", F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")
    ).select(F.concat_ws("\u001f", "_scope", "id").alias("a"), F.concat_ws("\u001f", "_scope", "alias").alias("b"))
    groups = connected_groups(edges)
    member = records.withColumn("node", F.concat_ws("\u001f", scope, F.col("id"))).join(groups, "node")
    severity = F.coalesce(
        lookup(
            F.upper("severity"),
            {"CRITICAL": "critical", "HIGH": "high", "MODERATE": "medium", "MEDIUM": "medium", "LOW": "low"},
        ),
        F.lit("unknown"),
    )
    rank = F.struct(
        F.when(F.coalesce("severity", F.lit("")) != "", 0).otherwise(1),
        F.when(F.col("id").startswith("GHSA"), 0).otherwise(1),
        F.col("id"),
    )
    same = lambda name, package: F.lower(F.regexp_replace(name, r"[-_.]+", "-")) == F.lower(
        F.regexp_replace(package, r"[-_.]+", "-")
    )
    named = F.filter(F.coalesce("affected", F.array().cast(member.schema["affected"].dataType)), lambda a: same(a["package"]["name"], F.col("package")))
    ranges = F.filter(F.flatten(F.transform(named, lambda a: a["ranges"])), lambda r: r["type"].isin("ECOSYSTEM", "SEMVER"))
    fixes = F.array_compact(F.transform(F.flatten(F.transform(ranges, lambda r: r["events"])), lambda e: e["fixed"]))
    return (
        member.withColumn("_fixes", fixes)
        .withColumn("_ids", F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
        .groupBy(*keys, "component")
        .agg(
            F.min_by(F.struct("id", severity.alias("severity"), "summary", "published"), rank).alias("_rep"),
            F.array_distinct(F.flatten(F.collect_set("_ids"))).alias("_ids"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_fixes")))).alias("fixed_versions"),
            F.min(F.nullif("summary", F.lit(""))).alias("_any_summary"),
        )
        .select(
            *keys,
            F.col("_rep.id").alias("advisory_id"),
            F.array_sort(F.array_except("_ids", F.array("_rep.id"))).alias("aliases"),
            F.col("_rep.severity").alias("severity"),
            F.coalesce(F.nullif("_rep.summary", F.lit("")), "_any_summary", F.lit("")).alias("summary"),
            F.col("_rep.published").alias("published"),
            "fixed_versions",
        )
    )


def vulnerable_dependencies(deps: DataFrame, groups: DataFrame) -> DataFrame:
    """Per pinned dependency: worst severity, the release that fixes everything, and how many have no fix.

    The fix is the highest among the groups' lowest fixes.
    """
    keys = ["ecosystem", "package", "version"]
    fixes = groups.select(*keys, "advisory_id", "severity", F.explode_outer("fixed_versions").alias("_fix"))
    key = version_key(F.col("_fix"), F.col("ecosystem"))
    per_group = fixes.groupBy(*keys, "advisory_id", "severity").agg(
        F.min_by("_fix", F.when(key.isNotNull(), key)).alias("_fix"),
    )
    per_package = per_group.groupBy(*keys).agg(
        F.count("*").alias("advisories"),
        F.max_by("severity", F.struct(advisory_rank(F.col("severity")), F.col("severity"))).alias("advisory_max_severity"),
        F.max_by("_fix", version_key(F.col("_fix"), F.col("ecosystem"))).alias("fixed_version"),
        F.count_if(F.col("_fix").isNull()).alias("unfixed"),
    )
    named = per_package.withColumnRenamed("package", "name")
    severity = F.when(
        F.col("advisory_max_severity").isin("critical", "high", "medium", "low"), F.col("advisory_max_severity")
    ).otherwise(F.lit("medium"))
    return deps.join(named, ["ecosystem", "name", "version"]).withColumn("severity", severity)


def freshness(deps_with_registry: DataFrame, now: Column) -> DataFrame:
    """Abandoned and outdated packages among those the registry knows."""
    latest_age = age_days(F.try_to_timestamp("latest_release_date"), now)
    gap = version_gap(F.col("version"), F.col("latest_version"), F.col("ecosystem"))
    known = deps_with_registry.where(F.col("registry_status") == "ok").withColumns(
        {
            "latest_release_age_days": latest_age,
            "gap": gap,
            "pinned_release_age_days": age_days(F.try_to_timestamp("pinned_release_date"), now),
        }
    )
    rules = F.array_compact(
        F.array(
            F.when(
                F.col("latest_release_age_days") > 730,
                F.struct(F.lit("dependency.abandoned").alias("rule_id"), F.lit("medium").alias("severity")),
            ),
            F.when(
                F.col("gap").isin("major", "minor"),
                F.struct(
                    F.lit("dependency.outdated").alias("rule_id"),
                    F.when(F.col("gap") == "major", "medium").otherwise("low").alias("severity"),
                ),
            ),
        )
    )
    return known.withColumn("_r", F.explode(rules)).select("*", "_r.rule_id", "_r.severity").drop("_r")


def unpinned_by_manifest(deps: DataFrame) -> DataFrame:
    """Runtime dependencies without an exact version that no lock file resolves, counted per manifest."""
    loose = deps.where(~F.col("pinned") & ~F.col("dev") & F.col("resolved_from").isNull())
    return loose.groupBy("repo_id", "manifest").agg(
        F.count("*").alias("unpinned"), F.array_sort(F.collect_set("name")).alias("packages")
    )


def conflicting_specs(deps: DataFrame) -> DataFrame:
    """Packages declared with more than one spec. Specs are reduced to distinct ones before they meet."""
    specs = deps.select("repo_id", "ecosystem", "name", "spec").distinct()
    return (
        specs.groupBy("repo_id", "ecosystem", "name")
        .agg(F.array_sort(F.collect_list("spec")).alias("specs"))
        .where(F.size("specs") > 1)
    )


def dependency_findings(vulnerable: DataFrame, fresh: DataFrame, unpinned: DataFrame, conflicts: DataFrame) -> DataFrame:
    """All dependency rules as findings: ``repo_id, rule_id, severity, subject, package, manifest``."""
    subject = F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name")
    none = F.lit(None).cast("string")
    return (
        vulnerable.select(
            "repo_id", F.lit("dependency.vulnerable").alias("rule_id"), "severity", subject.alias("subject"), F.col("name").alias("package"), "manifest"
        )
        .unionByName(
            fresh.select("repo_id", "rule_id", "severity", subject.alias("subject"), F.col("name").alias("package"), "manifest")
        )
        .unionByName(
            unpinned.select(
                "repo_id",
                F.lit("dependency.unpinned").alias("rule_id"),
                F.lit("low").alias("severity"),
                F.concat(F.lit("manifest:"), "manifest").alias("subject"),
                none.alias("package"),
                "manifest",
            )
        )
        .unionByName(
            conflicts.select(
                "repo_id",
                F.lit("dependency.conflicting_specs").alias("rule_id"),
                F.lit("low").alias("severity"),
                subject.alias("subject"),
                F.col("name").alias("package"),
                none.alias("manifest"),
            )
        )
    )


def usage_findings(vulnerable: DataFrame, imports: DataFrame, calls: DataFrame, components: DataFrame) -> DataFrame:
    """Per vulnerable package: production files that import it, its call sites and components, or "declared, unused".

    ``vulnerable(repo_id, package, import_name)``, ``imports(repo_id, path, root)``, ``calls(repo_id, path, root)``,
    ``components(repo_id, path, component)``.
    """
    root = F.split_part("import_name", F.lit("."), F.lit(1))
    wanted = vulnerable.select("repo_id", "package", root.alias("root")).distinct()
    users = imports.where(~is_test_path(F.col("path"))).select("repo_id", "path", "root").distinct().join(wanted, ["repo_id", "root"])
    sites = calls.join(wanted, ["repo_id", "root"]).join(
        users.select("repo_id", "path", "package"), ["repo_id", "path", "package"], "left_semi"
    )
    critical = F.col("component").isin("authentication", "authorization", "cryptography", "payments", "secrets")
    parts = (
        users.join(components.where(F.col("component") != "tests"), ["repo_id", "path"])
        .groupBy("repo_id", "package")
        .agg(F.min(F.when(critical, F.col("component"))).alias("_critical"), F.min("component").alias("_any"))
    )
    counts = users.groupBy("repo_id", "package").agg(F.countDistinct("path").alias("usage_files"))
    site_counts = sites.groupBy("repo_id", "package").agg(F.count("*").alias("call_sites"))
    used = F.col("usage_files").isNotNull()
    return (
        wanted.select("repo_id", "package")
        .distinct()
        .join(counts, ["repo_id", "package"], "left")
        .join(site_counts, ["repo_id", "package"], "left")
        .join(parts, ["repo_id", "package"], "left")
        .select(
            "repo_id",
            "package",
            F.when(used, F.lit("security.vulnerable_dependency_usage"))
            .otherwise(F.lit("security.vulnerable_dependency_unused"))
            .alias("rule_id"),
            F.when(~used, F.lit("low")).when(F.col("_critical").isNotNull(), F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
            F.coalesce("_critical", "_any", F.lit("application")).alias("component"),
            F.coalesce("usage_files", F.lit(0)).alias("usage_files"),
            F.coalesce("call_sites", F.lit(0)).alias("call_sites"),
            (~used).alias("is_hypothesis"),
        )
    )


def incompatible_licenses(deps_with_registry: DataFrame, projects: DataFrame) -> DataFrame:
    """Dependencies all of whose license options conflict with the project's license; ``projects(repo_id, license_id)``."""
    df = deps_with_registry.where(F.col("registry_status") == "ok").join(projects, "repo_id")
    options = F.transform(
        normalise_expression(F.col("registry_license")), lambda o: conflict_severity(F.col("license_id"), o)
    )
    return (
        df.withColumn("_o", options)
        .where((F.size("_o") > 0) & F.forall("_o", lambda s: s.isNotNull()))
        .withColumn("severity", F.get("_o", F.lit(0)))
        .drop("_o")
    )


# ---------------------------------------------------------------------------------------- upgrades
def _with_keys(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the key of each version column, worked out once a version instead of once a row; null stays null."""
    each = [rows.select(F.col(name).alias("_version")).distinct() for name in columns]
    versions = reduce(DataFrame.unionByName, each).distinct().where(F.col("_version").isNotNull())
    known = stage(versions.select("_version", version_key(F.col("_version"), F.lit("PyPI")).alias("_key")))
    keyed = rows
    for name, key in columns.items():
        keyed = keyed.join(known.select(F.col("_version").alias(name), F.col("_key").alias(key)), name, "left")
    return keyed.select(*rows.columns, *columns.values())


def applicable_break_rules(upgrades: DataFrame, rules: DataFrame) -> DataFrame:
    """Documented breaking changes between the current and the target version; no target means up to the latest.

    ``upgrades(repo_id, package, current_version, target_version)``. The package is the join key; the range is a filter.
    """
    asked = _with_keys(upgrades, {"current_version": "_current", "target_version": "_target"})
    ruled = _with_keys(rules, {"breaking_in": "_breaking"})
    current, target, breaking = F.col("_current"), F.col("_target"), F.col("_breaking")
    within = F.col("target_version").isNull() | target.isNull() | (target >= breaking)
    return asked.join(ruled, "package").where((current < breaking) & within).drop("_current", "_target", "_breaking")


def broken_call_sites(applicable: DataFrame, calls: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Call sites that a breaking change touches.

    ``calls(repo_id, path, line, resolved, keywords, receiver, receiver_call, method)``;
    ``assignments(repo_id, path, name, callee)`` tell which call a variable holds the result of.
    """
    # Three kinds of calls are joined with the rules, which are worked out once. One rule may apply to a package's upgrades of any version.
    asked = applicable.select("repo_id", "package", "id", "call", "condition", "keyword", "method").distinct()
    rules = stage(asked).select(
        "repo_id", "package", "id", "call", "condition", "keyword", "method", F.element_at(F.split("call", r"\."), -1).alias("_tail")
    ).withColumnRenamed("method", "_method")
    wildcard = F.col("call").startswith("*.")
    sites = calls.withColumn("_tail", F.element_at(F.split("resolved", r"\."), -1))
    by_call = sites.join(rules.where(F.col("condition") != "result_method_called"), ["repo_id", "_tail"]).where(
        (F.col("resolved") == F.col("call")) | (wildcard & F.endswith("resolved", F.expr("substring(call, 2)")))
    )
    # A call without a keyword list hands none over.
    has = F.coalesce(F.array_contains("keywords", F.col("keyword")), F.lit(False))
    hits = by_call.where(
        ((F.col("condition") == "missing_keyword") & ~has)
        | ((F.col("condition") == "has_keyword") & has)
        | (F.col("condition") == "called")
    ).select("repo_id", "package", "id", "path", "line")
    results = rules.where(F.col("condition") == "result_method_called")
    methods = calls.join(results, calls["method"] == results["_method"]).where(calls["repo_id"] == results["repo_id"])
    direct = methods.where(F.col("receiver_call") == F.col("call")).select(
        calls["repo_id"], "package", "id", "path", "line"
    )
    out = hits.unionByName(direct)
    if assignments is not None:
        held = assignments.select("repo_id", "path", F.col("name").alias("receiver"), "callee")
        left = calls.select("repo_id", "path", "line", "receiver", "method")
        via = (
            left.join(held, ["repo_id", "path", "receiver"])
            .join(results.withColumnRenamed("call", "callee").withColumnRenamed("_method", "method"), ["repo_id", "callee", "method"])
            .select("repo_id", "package", "id", "path", "line")
        )
        out = out.unionByName(via)
    return out.distinct()


def upgrade_findings(broken: DataFrame) -> DataFrame:
    """One finding per repository and package whose upgrade breaks call sites."""
    return broken.groupBy("repo_id", "package").agg(
        F.count("*").alias("call_sites"),
        F.countDistinct("path").alias("files"),
        F.array_sort(F.collect_set("id")).alias("breaking_rules"),
    ).withColumn("rule_id", F.lit("api.upgrade_breaking_changes")).withColumn("severity", F.lit("medium"))

"""Relationships between findings.

A candidate is a header row (``repo_id, signature, relationship_type, risk_multiplier, link_strength``) and one row per
member. Members stay in long form: a relationship may span a large share of a repository, and no list of them is ever
built in one task. Generators never pair all members of a group with each other; they pick a lead by an aggregate and
link the rest to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.functions.lookup import stable_round
from riskframe.functions.paths import is_test_path

KEY = ["repo_id", "signature"]
CARRIED = ["repo_id", "finding_id", "agent", "category", "status", "severity", "confidence", "created_at"]


def creation_order() -> Column:
    return F.struct("created_at", "finding_id")


def packages_of(package: str = "package", packages: str = "packages", related: str = "related_packages") -> Column:
    """Lower-case package names of a finding from all of its package attributes."""
    empty = F.array().cast("array<string>")
    every = F.concat(
        F.coalesce(F.col(packages), empty), F.coalesce(F.col(related), empty), F.array_compact(F.array(F.col(package)))
    )
    return F.array_distinct(F.transform(every, F.lower))


def open_findings(findings: DataFrame) -> DataFrame:
    """What takes part in correlation: findings that are not rejected, with the optional columns filled in."""
    df = findings.where(F.col("status") != "rejected")
    for name in ("related_packages", "usage_files"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("array<string>"))
    return df.withColumn("_packages", packages_of())


def _members(df: DataFrame, lead: Column) -> DataFrame:
    return df.select(*CARRIED, "signature", lead.alias("is_lead"))


def _with_headers(members: DataFrame, kind: str, strength: float, multiplier: Column | float = 1.0, order: int = 0) -> DataFrame:
    value = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return (
        members.withColumn("relationship_type", F.lit(kind))
        .withColumn("risk_multiplier", stable_round(value, 2))
        .withColumn("link_strength", F.lit(strength))
        .withColumn("generator", F.lit(order))
    )


def contradictions(findings: DataFrame) -> DataFrame:
    """Same subject, one side says acceptable and another reports an issue: the first of each side."""
    f = findings.where(F.col("subject").isNotNull())
    acceptable = F.coalesce(F.col("stance") == "acceptable", F.lit(False))
    issue = (F.col("severity") != "info") & ~acceptable
    sides = f.groupBy("repo_id", "subject").agg(
        F.min(F.when(issue, creation_order())).alias("_issue"), F.min(F.when(acceptable, creation_order())).alias("_acceptable")
    )
    pairs = sides.where(F.col("_issue").isNotNull() & F.col("_acceptable").isNotNull())
    chosen = pairs.select(
        "repo_id",
        F.concat(F.lit("contradiction:"), "subject").alias("signature"),
        F.explode(
            F.array(
                F.struct(F.col("_issue.finding_id").alias("finding_id"), F.lit(True).alias("is_lead")),
                F.struct(F.col("_acceptable.finding_id").alias("finding_id"), F.lit(False).alias("is_lead")),
            )
        ).alias("m"),
    ).select("repo_id", "signature", "m.*")
    members = chosen.join(f.select(*CARRIED), ["repo_id", "finding_id"])
    return _with_headers(_members(members, F.col("is_lead")), "contradiction", 0.9, 1.0, 0)


def _lead_of_group(members: DataFrame, first: Column | None = None) -> DataFrame:
    """Mark the first member by (priority, creation) as the lead: one aggregate joined back, no window over the group."""
    rank = F.struct(first, *[F.col(c) for c in ("created_at", "finding_id")]) if first is not None else creation_order()
    leads = members.groupBy(*KEY).agg(F.min_by("finding_id", rank).alias("_lead"))
    return members.join(leads, KEY).withColumn("is_lead", F.col("finding_id") == F.col("_lead")).drop("_lead")


def shared_root_causes(findings: DataFrame) -> DataFrame:
    """Two or more dependency findings of one package."""
    f = findings.where((F.col("category") == "dependency") & F.col("package").isNotNull()).withColumn(
        "signature", F.concat(F.lit("root:"), F.lower("package"))
    )
    groups = f.groupBy(*KEY).agg(F.count("*").alias("_n"), F.min(creation_order()).alias("_first")).where(F.col("_n") >= 2)
    members = f.join(groups, KEY)
    return _with_headers(
        _members(members, F.col("finding_id") == F.col("_first.finding_id")), "shared_root_cause", 0.95, 1.0, 1
    )


def dependency_compounds(findings: DataFrame) -> DataFrame:
    """A vulnerable package, the code findings that use it, and the test findings on the same files or package.

    One compound per package: when several findings report the same vulnerable package, the latest leads.
    """
    package = F.lower("package")
    vulnerable = (
        findings.where((F.col("category") == "dependency") & F.col("vulnerable") & F.col("package").isNotNull())
        .withColumn("_pkg", package)
        .groupBy("repo_id", "_pkg")
        .agg(F.max_by(F.struct(*[F.col(c) for c in CARRIED if c != "repo_id"]), creation_order()).alias("_v"))
        .select("repo_id", "_pkg", "_v.*")
    )
    keys = vulnerable.select("repo_id", "_pkg")
    by_package = (
        findings.where(F.col("category") != "dependency")
        .withColumn("_pkg", F.explode("_packages"))
        .join(keys, ["repo_id", "_pkg"], "left_semi")
    )
    usage = by_package.where(F.col("category") != "testing")
    used = usage.select("repo_id", "_pkg").distinct()
    usage_files = usage.select(
        "repo_id",
        "_pkg",
        F.explode(
            F.array_distinct(
                F.concat(F.col("affected_files"), F.coalesce(F.col("usage_files"), F.array().cast("array<string>")))
            )
        ).alias("_file"),
    ).distinct()
    tests_by_file = (
        findings.where(F.col("category") == "testing")
        .withColumn("_file", F.explode("affected_files"))
        .join(usage_files, ["repo_id", "_file"])
    )
    tests_by_package = by_package.where(F.col("category") == "testing").join(used, ["repo_id", "_pkg"], "left_semi")
    tests = (
        tests_by_file.select(*CARRIED, "_pkg").unionByName(tests_by_package.select(*CARRIED, "_pkg")).dropDuplicates(
            ["repo_id", "_pkg", "finding_id"]
        )
    )
    members = (
        vulnerable.join(used, ["repo_id", "_pkg"], "left_semi")
        .select(*CARRIED, "_pkg")
        .withColumn("is_lead", F.lit(True))
        .unionByName(usage.select(*CARRIED, "_pkg").withColumn("is_lead", F.lit(False)))
        .unionByName(tests.withColumn("is_lead", F.lit(False)))
        .withColumn("signature", F.concat(F.lit("compound:dep:"), "_pkg"))
        .drop("_pkg")
    )
    dimensions = members.groupBy(*KEY).agg(F.size(F.collect_set("category")).alias("_dimensions"))
    multiplier = F.least(F.lit(2.0), 1 + F.lit(0.25) * (F.col("_dimensions") - 1))
    return _with_headers(members.join(dimensions, KEY), "compound_risk", 0.95, multiplier, 2).drop("_dimensions")


def component_clusters(findings: DataFrame) -> DataFrame:
    """Several security findings in one critical component, with its test findings when there are any."""
    in_tests = F.forall("affected_files", is_test_path) & (F.size("affected_files") > 0)
    security = (
        (F.col("category") == "security")
        & ~in_tests
        & ~F.col("rule_id").isin("security.vulnerable_dependency_usage", "security.hardcoded_secret")
    )
    testing = F.col("category") == "testing"
    f = (
        findings.withColumn("_security", security)
        .where(F.col("_security") | testing)
        .withColumn("_component", F.explode(F.array_distinct("affected_components")))
        .where(F.col("_component").isin(*C.CRITICAL_COMPONENTS))
        .withColumn("signature", F.concat(F.lit("cluster:"), "_component"))
    )
    groups = (
        f.groupBy(*KEY)
        .agg(
            F.count_if("_security").alias("_n_security"),
            F.count_if(~F.col("_security")).alias("_n_tests"),
            F.min(F.when(F.col("_security"), creation_order())).alias("_first"),
        )
        .where(((F.col("_n_security") >= 2) & (F.col("_n_tests") > 0)) | (F.col("_n_security") >= 3))
    )
    multiplier = F.least(F.lit(1.5), 1 + F.lit(0.1) * F.col("_n_security"))
    joined = f.join(groups, KEY)
    members = joined.select(
        *CARRIED, "signature", (F.col("finding_id") == F.col("_first.finding_id")).alias("is_lead"), "_n_security"
    )
    return _with_headers(members, "compound_risk", 0.8, multiplier, 3).drop("_n_security")


def performance_in_complex_code(findings: DataFrame) -> DataFrame:
    """A performance finding and the code-quality findings on its files. The latest finding stands for its rule on a file."""
    perf = findings.where((F.col("category") == "performance") & (F.size("affected_files") > 0)).withColumn(
        "signature", F.concat_ws(":", F.lit("perfarch"), F.get("affected_files", F.lit(0)), "rule_id")
    )
    quality = (
        findings.where((F.col("category") == "code_quality") & (F.coalesce(F.col("stance"), F.lit("")) != "acceptable"))
        .withColumn("_file", F.explode(F.array_distinct("affected_files")))
        .select(*CARRIED, "_file")
    )
    touched = quality.select("repo_id", "_file").distinct()
    spread = perf.withColumn("_file", F.explode(F.array_distinct("affected_files")))
    related_perf = spread.join(touched, ["repo_id", "_file"], "left_semi")
    leads = (
        related_perf.groupBy(*KEY)
        .agg(F.max_by(F.struct(*[F.col(c) for c in CARRIED if c != "repo_id"], "affected_files"), creation_order()).alias("_p"))
        .select(*KEY, "_p.*")
    )
    lead_files = leads.select(*KEY, F.explode(F.array_distinct("affected_files")).alias("_file"))
    related = quality.join(lead_files, ["repo_id", "_file"]).dropDuplicates([*KEY, "finding_id"])
    members = (
        leads.select(*CARRIED, "signature")
        .withColumn("is_lead", F.lit(True))
        .unionByName(related.select(*CARRIED, "signature").withColumn("is_lead", F.lit(False)))
    )
    return _with_headers(members, "causal", 0.8, 1.1, 4)


def maintenance_and_dependencies(findings: DataFrame) -> DataFrame:
    """A weakly maintained repository with vulnerable packages."""
    maintenance = (F.col("category") == "maintenance") & F.col("rule_id").isin(
        "maintenance.inactive", "maintenance.archived", "maintenance.bus_factor"
    )
    vulnerable = (F.col("category") == "dependency") & F.coalesce(F.col("vulnerable"), F.lit(False))
    f = findings.withColumn("_maintenance", maintenance).where(F.col("_maintenance") | vulnerable)
    repos = (
        f.groupBy("repo_id")
        .agg(
            F.count_if("_maintenance").alias("_m"),
            F.count_if(~F.col("_maintenance")).alias("_v"),
            F.min(F.when(F.col("_maintenance"), creation_order())).alias("_first"),
        )
        .where((F.col("_m") > 0) & (F.col("_v") > 0))
    )
    members = f.join(repos, "repo_id").withColumn("signature", F.lit("maint:dep"))
    return _with_headers(
        _members(members, F.col("finding_id") == F.col("_first.finding_id")), "compound_risk", 0.75, 1.3, 5
    )


def dependency_links(findings: DataFrame) -> DataFrame:
    """An unpinned package and the other findings that name it. The latest unpinned finding leads."""
    unpinned = (
        findings.where((F.col("rule_id") == "dependency.unpinned") & F.col("packages").isNotNull())
        .withColumn("_pkg", F.explode(F.array_distinct("packages")))
        .groupBy("repo_id", "_pkg")
        .agg(F.max_by(F.struct(*[F.col(c) for c in CARRIED if c != "repo_id"]), creation_order()).alias("_d"))
        .select("repo_id", "_pkg", "_d.*")
    )
    related = (
        findings.where(F.col("category") != "dependency")
        .withColumn("_pkg", F.explode("_packages"))
        .join(unpinned.select("repo_id", "_pkg"), ["repo_id", "_pkg"], "left_semi")
    )
    used = related.select("repo_id", "_pkg").distinct()
    members = (
        unpinned.join(used, ["repo_id", "_pkg"], "left_semi")
        .select(*CARRIED, "_pkg")
        .withColumn("is_lead", F.lit(True))
        .unionByName(related.select(*CARRIED, "_pkg").withColumn("is_lead", F.lit(False)))
        .withColumn("signature", F.concat(F.lit("deplink:"), "_pkg"))
        .drop("_pkg")
    )
    return _with_headers(members, "dependency", 0.85, 1.05, 6)


def duplicate_links(findings: DataFrame) -> DataFrame:
    """Each later report of a location, linked to the earliest report of it by another agent.

    A location is a repository, category, file and line. Linking to the earliest report keeps the output linear in the
    input; the set of findings that have an earlier twin is the same as with all pairs of the location.
    """
    spots = (
        findings.select("repo_id", "category", "agent", "created_at", "finding_id", "affected_files", "lines")
        .withColumn("_file", F.explode(F.array_distinct("affected_files")))
        .withColumn("_line", F.explode(F.array_distinct("lines")))
        .drop("affected_files", "lines")
    )
    place = ["repo_id", "category", "_file", "_line"]
    # Two aggregate levels find the first report and the first one by any other agent, without sorting a hot location.
    by_agent = spots.groupBy(*place, "agent").agg(F.min(creation_order()).alias("_first"))
    heads = by_agent.groupBy(*place).agg(
        F.min(F.struct(F.col("_first"), F.col("agent"))).alias("_a"), F.count("*").alias("_agents")
    )
    seconds = (
        by_agent.join(heads.where(F.col("_agents") > 1), place)
        .where(F.col("agent") != F.col("_a.agent"))
        .groupBy(*place)
        .agg(F.min(F.struct(F.col("_first"), F.col("agent"))).alias("_b"), F.first("_a").alias("_a"))
    )
    mine = F.struct("created_at", "finding_id")
    partner = F.when(F.col("agent") != F.col("_a.agent"), F.col("_a._first")).otherwise(F.col("_b._first"))
    return (
        spots.join(seconds, place)
        .withColumn("_partner", partner)
        .where(F.col("_partner") < mine)
        .select("repo_id", F.col("_partner.finding_id").alias("lead_id"), "finding_id")
        .distinct()
    )


def duplicates(findings: DataFrame) -> DataFrame:
    pairs = duplicate_links(findings).withColumn(
        "signature",
        F.concat_ws(":", F.lit("dup"), F.least("lead_id", "finding_id"), F.greatest("lead_id", "finding_id")),
    )
    members = pairs.select(
        "repo_id",
        "signature",
        F.explode(
            F.array(
                F.struct(F.col("lead_id").alias("finding_id"), F.lit(True).alias("is_lead")),
                F.struct(F.col("finding_id"), F.lit(False).alias("is_lead")),
            )
        ).alias("m"),
    ).select("repo_id", "signature", "m.*")
    full = members.join(findings.select(*CARRIED), ["repo_id", "finding_id"])
    return _with_headers(_members(full, F.col("is_lead")), "duplicate", 0.9, 1.0, 7)


GENERATORS = (
    contradictions,
    shared_root_causes,
    dependency_compounds,
    component_clusters,
    performance_in_complex_code,
    maintenance_and_dependencies,
    dependency_links,
    duplicates,
)


def candidate_members(findings: DataFrame) -> DataFrame:
    """All candidates of all generators, one row per member."""
    f = open_findings(findings)
    out = GENERATORS[0](f)
    for generate in GENERATORS[1:]:
        out = out.unionByName(generate(f))
    return out


def members_key() -> Column:
    """A key of a set of members, whatever their order: the sum of their ids' hashes."""
    return F.sum(F.xxhash64("finding_id").cast("decimal(38,0)"))


def assess(members: DataFrame, *further: Column) -> DataFrame:
    """One row per candidate; confidence = geometric mean of the members' confidences times the link strength.

    ``further`` aggregates of the members are taken in the same pass.
    """
    mean = F.exp(F.avg(F.ln(F.greatest(F.lit(0.01), F.col("confidence")))))
    return (
        members.groupBy(*KEY, "relationship_type", "risk_multiplier", "link_strength")
        .agg(mean.alias("_mean"), F.count("*").alias("n_members"), F.size(F.collect_set("agent")).alias("n_agents"), members_key().alias("members_key"), *further)
        .withColumn(
            "confidence",
            stable_round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("_mean") * F.col("link_strength"))), 3),
        )
        .withColumn("status", F.lit("proposed"))
        .drop("_mean")
    )


def upsert_correlations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace current ones of the same signature.

    A ruling (verified or rejected) stands while the members stay the same (by their ids, not their number); a changed
    relationship is proposed again.
    """
    old = current.select(*KEY, F.col("status").alias("_old_status"), F.col("n_members").alias("_old_n"), F.col("members_key").alias("_old_key"))
    changed = (F.col("_old_n") != F.col("n_members")) | (F.col("_old_key") != F.col("members_key"))
    merged = incoming.join(old, KEY, "left").withColumn(
        "status",
        F.when(F.col("_old_status").isNull(), F.col("status"))
        .when(
            F.col("_old_status").isin("verified", "rejected") & changed, F.lit("proposed")
        )
        .otherwise(F.col("_old_status")),
    )
    kept = current.join(incoming.select(*KEY), KEY, "left_anti")
    return merged.drop("_old_status", "_old_n", "_old_key").unionByName(kept)


def member_updates(members: DataFrame) -> DataFrame:
    """What correlation changes on each member: status, contradiction count, corroborating agents (three at most).

    When several relationships corroborate a finding, the last generator counts.
    """
    corroborating = F.col("relationship_type").isin("compound_risk", "causal", "shared_root_cause")
    agents = (
        members.where(corroborating)
        .groupBy(*KEY)
        .agg((F.size(F.collect_set("agent")) - 1).alias("_others"), F.max("generator").alias("_generator"))
        .where(F.col("_others") > 0)
    )
    joined = members.join(agents, KEY, "left")
    return joined.groupBy("repo_id", "finding_id").agg(
        F.first("status").alias("old_status"),
        F.max(F.when(F.col("relationship_type") == "contradiction", F.lit(1))).alias("contradictions"),
        F.max_by(
            F.least(F.lit(3), F.col("_others")), F.when(F.col("_others").isNotNull(), F.struct("_generator", "signature"))
        ).alias("corroborating_agents"),
    ).withColumn("status", F.when(F.col("old_status") == "proposed", F.lit("correlated")).otherwise(F.col("old_status")))

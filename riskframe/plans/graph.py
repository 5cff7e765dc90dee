"""Queries on graphs and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import versions
from riskframe.operators import deps, graph
from riskframe.plans.registry import ORACLES, query
from riskframe.session import stage
from riskframe.sources import manifests, snapshots
from riskframe.sources.adapters import adapt, table

MODULE_SQL = "(CASE WHEN {p} % 10 = 0 THEN concat('tests/test_m', {p}, '.py') WHEN {p} % 97 = 1 THEN concat('src/api/m', {p}, '.py') ELSE concat('src/core/m', {p}, '.py') END)"
# Imports halve the module number, so chains are as deep as its bits; line 7 points upwards and makes cycles.
IMPORTED = "(CASE WHEN l_linenumber = 7 THEN l_partkey + 1 ELSE CAST(floor(l_partkey / 2) AS BIGINT) END)"
EDGES_SQL = f"""edges AS (SELECT DISTINCT l_suppkey % 20 AS repo_id, {MODULE_SQL.format(p='l_partkey')} AS importer, {MODULE_SQL.format(p=IMPORTED)} AS path FROM lineitem),
    nodes AS (SELECT DISTINCT repo_id, path FROM (SELECT repo_id, importer AS path FROM edges UNION ALL SELECT repo_id, path FROM edges))"""


def import_edges(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(
        "l_suppkey % 20 AS repo_id", f"{MODULE_SQL.format(p='l_partkey')} AS importer", f"{MODULE_SQL.format(p=IMPORTED)} AS path"
    ).distinct()


def nodes_of(edges):
    return edges.select("repo_id", F.col("importer").alias("path")).unionByName(edges.select("repo_id", "path")).distinct()


@query(
    "reachability",
    f"""WITH RECURSIVE {EDGES_SQL},
    reach(repo_id, node, label) AS (
      SELECT DISTINCT e.repo_id, e.path, l.label FROM edges e, LATERAL (SELECT unnest(['any', CASE WHEN NOT starts_with(importer, 'tests/') THEN 'production' END, CASE WHEN contains(importer, '/api/') AND NOT starts_with(importer, 'tests/') THEN 'entry' END]) AS label) l WHERE label IS NOT NULL
      UNION SELECT r.repo_id, e.path, r.label FROM reach r JOIN edges e ON e.repo_id = r.repo_id AND e.importer = r.node),
    best AS (SELECT repo_id, node, max(label = 'entry') AS e, max(label = 'production') AS p FROM reach GROUP BY ALL)
    SELECT n.repo_id, n.path, CASE WHEN contains(n.path, '/api/') OR coalesce(e, false) THEN 'entrypoint' WHEN p THEN 'reachable' WHEN p IS NOT NULL THEN 'test_only' ELSE 'unreferenced' END AS reach
    FROM nodes n LEFT JOIN best b ON b.repo_id = n.repo_id AND b.node = n.path""",
)
def reachability(spark, sf_dir):
    edges = stage(import_edges(spark, sf_dir))
    nodes = nodes_of(edges)
    return graph.reach_of_files(nodes, edges, nodes.where(F.contains("path", F.lit("/api/"))))


@query(
    "transitive_importers",
    f"""WITH RECURSIVE {EDGES_SQL}, asked AS (SELECT repo_id, path FROM nodes WHERE contains(path, '/api/')),
    up(repo_id, path, importer) AS (SELECT a.repo_id, a.path, e.importer FROM asked a JOIN edges e ON e.repo_id = a.repo_id AND e.path = a.path
      UNION SELECT u.repo_id, u.path, e.importer FROM up u JOIN edges e ON e.repo_id = u.repo_id AND e.path = u.importer)
    SELECT repo_id, path, count(*) AS importers FROM up WHERE importer <> path OR (repo_id, path) IN (SELECT repo_id, path FROM edges WHERE importer = path) GROUP BY ALL""",
)
def transitive_importers(spark, sf_dir):
    edges = import_edges(spark, sf_dir)
    asked = nodes_of(edges).where(F.contains("path", F.lit("/api/")))
    found = graph.transitive_importers(edges, asked)
    return found.groupBy("repo_id", "path").agg(F.count("*").alias("importers"))


@query(
    "untested_files",
    f"""WITH {EDGES_SQL} SELECT repo_id, path FROM nodes WHERE NOT starts_with(path, 'tests/') AND (repo_id, path) NOT IN (SELECT repo_id, path FROM edges WHERE starts_with(importer, 'tests/'))""",
)
def untested_files(spark, sf_dir):
    edges = import_edges(spark, sf_dir)
    return graph.untested_files(nodes_of(edges), edges)


@query(
    "alias_groups",
    """WITH RECURSIVE e AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS a, 'l' || sha256(split_part(text, chr(10), 1)) AS b FROM documents
      UNION SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 'l' || sha256(string_split(text, chr(10))[-1]) FROM documents),
    pairs AS (SELECT DISTINCT x.a AS a, y.a AS b FROM e x JOIN e y USING (b)),
    walk(a, b) AS (SELECT a, b FROM pairs UNION SELECT w.a, p.b FROM walk w JOIN pairs p ON p.a = w.b)
    SELECT a AS document, min(b) AS group_id FROM walk GROUP BY a""",
)
def alias_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    lines = F.split("text", "\n")
    keys = F.array(
        F.concat(F.lit("l"), F.sha2(F.get(lines, F.lit(0)), 256)), F.concat(F.lit("l"), F.sha2(F.element_at(lines, -1), 256))
    )
    edges = docs.select(name.alias("a"), F.explode(keys).alias("b"))
    groups = graph.connected_groups(edges)
    return groups.where(F.col("node").startswith("d")).select(
        F.col("node").alias("document"), F.col("component").alias("group_id")
    )


@query(
    "module_resolution",
    """WITH names AS (SELECT DISTINCT l_suppkey % 20 AS repo_id, 'pkg' || (l_partkey % 40) || '.mod' || (l_partkey % 6) || '.fn' || l_linenumber AS target FROM lineitem),
    modules AS (SELECT DISTINCT l_suppkey % 20 AS repo_id, CASE WHEN l_partkey % 3 = 0 THEN 'pkg' || (l_partkey % 30) ELSE 'pkg' || (l_partkey % 30) || '.mod' || (l_partkey % 4) END AS module FROM lineitem),
    hits AS (SELECT n.repo_id, n.target, arg_max(module, length(module)) AS module FROM names n JOIN modules m ON m.repo_id = n.repo_id AND starts_with(n.target || '.', m.module || '.') GROUP BY ALL)
    SELECT n.repo_id, n.target, h.module FROM names n LEFT JOIN hits h ON h.repo_id = n.repo_id AND h.target = n.target""",
)
def module_resolution(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    names = items.selectExpr(
        "l_suppkey % 20 AS repo_id", "concat('pkg', l_partkey % 40, '.mod', l_partkey % 6, '.fn', l_linenumber) AS target"
    ).distinct()
    modules = items.selectExpr(
        "l_suppkey % 20 AS repo_id",
        "CASE WHEN l_partkey % 3 = 0 THEN concat('pkg', l_partkey % 30) ELSE concat('pkg', l_partkey % 30, '.mod', l_partkey % 4) END AS module",
    ).distinct()
    found = graph.longest_prefix_match(names, modules.withColumn("path", F.col("module")))
    return found.select("repo_id", "target", "module")


# ------------------------------------------------------------------------------------- dependencies
@query(
    "conflicting_specs",
    "SELECT repo_id, name, string_agg(DISTINCT spec, ',' ORDER BY spec) AS specs FROM deps GROUP BY repo_id, name HAVING count(DISTINCT spec) > 1",
    uses=("deps",),
)
def conflicting_specs(spark, sf_dir):
    found = deps.conflicting_specs(adapt(spark, sf_dir, "deps"))
    return found.select("repo_id", "name", F.array_join("specs", ",").alias("specs"))


@query(
    "unpinned_by_manifest",
    """SELECT repo_id, manifest, count(*) AS unpinned, count(DISTINCT name) AS packages FROM deps WHERE NOT pinned AND NOT dev AND resolved_from IS NULL GROUP BY ALL""",
    uses=("deps",),
)
def unpinned_by_manifest(spark, sf_dir):
    found = deps.unpinned_by_manifest(adapt(spark, sf_dir, "deps"))
    return found.select("repo_id", "manifest", "unpinned", F.size("packages").cast("bigint").alias("packages"))


ADVISORIES_SQL = """advisories AS (SELECT DISTINCT 'pkg' || (l_partkey % 150) AS package, (l_suppkey % 3) || '.' || (l_suppkey % 10) || '.' || (l_partkey % 7) AS version,
      'GHSA-' || (l_partkey % 150) || '-' || (l_linenumber % 4) AS id FROM lineitem)"""


@query(
    "advisory_lookup",
    f"""WITH {ADVISORIES_SQL}, k AS (SELECT package, version, count(*) AS n FROM advisories GROUP BY ALL)
    SELECT CASE WHEN d.version IS NULL THEN 'unpinned' WHEN n IS NULL THEN 'unavailable' ELSE 'ok' END AS advisory_status, count(*) AS n
    FROM deps d LEFT JOIN k ON k.package = d.name AND k.version = d.version GROUP BY 1""",
    uses=("deps",),
)
def advisory_lookup(spark, sf_dir):
    advisories = (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "'PyPI' AS ecosystem",
            "concat('pkg', l_partkey % 150) AS package",
            "concat(l_suppkey % 3, '.', l_suppkey % 10, '.', l_partkey % 7) AS version",
            "concat('GHSA-', l_partkey % 150, '-', l_linenumber % 4) AS id",
        )
        .distinct()
    )
    looked_up = deps.advisory_status(adapt(spark, sf_dir, "deps"), advisories)
    return looked_up.groupBy("advisory_status").agg(F.count("*").alias("n"))


@query(
    "version_gap",
    """WITH v AS (SELECT p_partkey, p_brand, p_size % 3 AS a, p_partkey % 10 AS b, p_partkey % 7 AS c FROM part),
    m AS (SELECT p_brand, max((a, b, c)) AS latest FROM v GROUP BY p_brand)
    SELECT p_partkey, latest[1] || '.' || latest[2] || '.' || latest[3] AS latest_version,
      CASE WHEN (a, b, c) >= latest THEN 'current' WHEN a < latest[1] THEN 'major' WHEN b < latest[2] THEN 'minor' ELSE 'patch' END AS gap FROM v JOIN m USING (p_brand)""",
)
def version_gap(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand", "concat(p_size % 3, '.', p_partkey % 10, '.', p_partkey % 7) AS version"
    )
    python = F.lit("PyPI")
    latest = parts.groupBy("p_brand").agg(F.max_by("version", versions.version_key(F.col("version"), python)).alias("latest_version"))
    return parts.join(latest, "p_brand").select(
        "p_partkey",
        "latest_version",
        versions.version_gap(F.col("version"), F.col("latest_version"), python).alias("gap"),
    )


@query(
    "requirement_files",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN 'Pkg_' || (l_partkey % 200) || '==' || (l_partkey % 3) || '.' || (l_partkey % 10) ELSE 'pkg.' || (l_partkey % 200) || '>=' || (l_partkey % 5) END AS t FROM lineitem),
    u AS (SELECT l_orderkey AS repo_id, 'pkg-' || (l_partkey % 200) AS name, CASE WHEN l_linenumber % 2 = 1 THEN (l_partkey % 3) || '.' || (l_partkey % 10) END AS version, t,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY t) AS line FROM r)
    SELECT repo_id, name, min(line) AS line FROM u GROUP BY ALL""",
)
def requirement_files(spark, sf_dir):
    text = (
        "CASE WHEN l_linenumber % 2 = 1 THEN concat('Pkg_', l_partkey % 200, '==', l_partkey % 3, '.', l_partkey % 10) "
        "ELSE concat('pkg.', l_partkey % 200, '>=', l_partkey % 5) END"
    )
    # An order has at most a handful of lines: one small requirements file each.
    files = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("l_orderkey AS repo_id", f"{text} AS t")
        .groupBy("repo_id")
        .agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("text"))
        .withColumn("path", F.lit("requirements.txt"))
    )
    found = manifests.requirement_files(files)
    return found.groupBy("repo_id", "name").agg(F.min("line").cast("bigint").alias("line"))


@query(
    "benchmark_scaling",
    """WITH b AS (SELECT o_orderpriority AS bench_id, CAST(floor(o_totalprice / 50000) AS BIGINT) + 1 AS n, count(*) AS queries FROM orders GROUP BY ALL),
    g AS (SELECT bench_id, count(*) AS points, arg_min(n, n) AS n0, arg_max(n, n) AS n1, arg_min(queries, n) AS q0, arg_max(queries, n) AS q1, min(queries / n) AS per_row FROM b GROUP BY bench_id)
    SELECT bench_id, points, points >= 2 AND per_row >= 0.9 AND q1 / q0 >= 0.8 * n1 / n0 AS confirmed, round(n1 / n0, 6) AS input_growth, round(q1 / q0, 6) AS query_growth FROM g""",
)
def benchmark_scaling(spark, sf_dir):
    results = (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderpriority").alias("bench_id"), (F.floor(F.col("o_totalprice") / 50_000).cast("bigint") + 1).alias("n")
        )
        .groupBy("bench_id", "n")
        .agg(F.count("*").alias("queries"))
        .withColumn("seconds", F.lit(None).cast("double"))
    )
    verdict = snapshots.scaling_verdict(results)
    return verdict.select(
        "bench_id",
        "points",
        "confirmed",
        F.round("input_growth", 6).alias("input_growth"),
        F.round("query_growth", 6).alias("query_growth"),
    )


@query(
    "version_tags",
    """WITH v AS (SELECT DISTINCT l_suppkey AS library, (l_partkey % 3) || '.' || (l_partkey % 10) AS version FROM lineitem),
    t AS (SELECT DISTINCT l_suppkey AS library, CASE l_linenumber WHEN 1 THEN 'V' WHEN 2 THEN 'Release-' WHEN 3 THEN 'lib-' ELSE 'other-' END || (l_partkey % 3) || '.' || (l_partkey % 10) AS tag FROM lineitem),
    c AS (SELECT v.library, version, tag, CASE lower(tag) WHEN 'v' || version THEN 1 WHEN 'lib-' || version THEN 2 WHEN 'release-' || version THEN 5 END AS rk FROM v JOIN t ON t.library = v.library)
    SELECT library, version, arg_min(tag, rk) AS tag FROM c WHERE rk IS NOT NULL GROUP BY ALL""",
)
def version_tags(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    wanted = items.selectExpr(
        "l_suppkey AS library", "concat(l_partkey % 3, '.', l_partkey % 10) AS version", "'lib' AS package"
    ).distinct()
    prefix = "CASE l_linenumber WHEN 1 THEN 'V' WHEN 2 THEN 'Release-' WHEN 3 THEN 'lib-' ELSE 'other-' END"
    tags = (
        items
        .selectExpr("l_suppkey AS library", f"concat({prefix}, l_partkey % 3, '.', l_partkey % 10) AS tag")
        .distinct()
    )
    return manifests.tag_of_version(wanted, tags)


REACH_CASE = "CASE {x} WHEN 'entrypoint' THEN 0 WHEN 'reachable' THEN 1 WHEN 'test_only' THEN 2 WHEN 'unreferenced' THEN 3 ELSE 4 END"


@query(
    "dependency_reach",
    ORACLES["reachability"].replace(
        "SELECT n.repo_id, n.path, CASE",
        "uses AS (SELECT DISTINCT l_suppkey % 20 AS repo_id, 'lib' || (l_partkey % 50) AS package, " + MODULE_SQL.format(p="l_partkey") + " AS path FROM lineitem), found AS (SELECT n.repo_id, n.path, CASE",
    ).replace("GROUP BY ALL)\n    uses AS", "GROUP BY ALL),\n    uses AS")
    + f") SELECT repo_id, package, arg_min(reach, {REACH_CASE.format(x='reach')}) AS reach FROM uses JOIN found USING (repo_id, path) GROUP BY repo_id, package",
)
def dependency_reach(spark, sf_dir):
    edges = import_edges(spark, sf_dir)
    entries = nodes_of(edges).where(F.contains("path", F.lit("/api/")))
    uses = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 20 AS repo_id", "concat('lib', l_partkey % 50) AS package", f"{MODULE_SQL.format(p='l_partkey')} AS path"
    )
    return graph.best_reach_of_members(uses, edges, entries, ["repo_id", "package"])


# Names form chains of 100 by key: n1 re-exports n0 of its library, and so on; in every fifth library the chain is a circle.
CHAIN_SQL = """names AS (SELECT 'lib' || (p_partkey // 100) AS library, p_partkey // 100 AS l, p_partkey % 100 AS k FROM part),
  aliases AS (SELECT library, 'n' || k AS name, 'n' || (k - 1) AS source FROM names WHERE k > 0
    UNION ALL SELECT library, 'n0', 'n' || max(k) FROM names WHERE l % 5 = 4 GROUP BY library
    UNION ALL SELECT library, 'also' || k, 'n' || k FROM names WHERE k % 10 = 0),
  symbols AS (SELECT library, 'n' || k AS name FROM names WHERE (k = 0 AND l % 5 <> 4) OR (k = 50 AND l % 3 = 0))"""


def chains(spark, sf_dir):
    key = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(
        F.concat(F.lit("lib"), F.floor(key / 100).cast("string")).alias("library"), F.floor(key / 100).alias("l"), (key % 100).alias("k")
    )
    name = lambda head, k: F.concat(F.lit(head), k.cast("string"))
    k = F.col("k")
    aliases = (
        names.where("k > 0")
        .select("library", name("n", k).alias("name"), name("n", k - 1).alias("source"))
        .unionByName(names.where("l % 5 = 4").groupBy("library").agg(F.lit("n0").alias("name"), name("n", F.max("k")).alias("source")))
        .unionByName(names.where("k % 10 = 0").select("library", name("also", k).alias("name"), name("n", k).alias("source")))
    )
    symbols = names.where("(k = 0 AND l % 5 <> 4) OR (k = 50 AND l % 3 = 0)").select("library", name("n", k).alias("name"))
    return aliases, symbols


@query(
    "resolved_reexports",
    f"""WITH RECURSIVE {CHAIN_SQL}, walk(library, name, here) AS (
      SELECT library, name, source FROM aliases
      UNION SELECT w.library, w.name, a.source FROM walk w JOIN aliases a ON a.library = w.library AND a.name = w.here
        WHERE (w.library, w.here) NOT IN (SELECT library, name FROM symbols))
    SELECT library, name, here AS target FROM walk WHERE (library, here) IN (SELECT library, name FROM symbols)""",
)
def resolved_reexports(spark, sf_dir):
    return graph.follow_aliases(*chains(spark, sf_dir))


@query(
    "propagated_contracts",
    f"""WITH RECURSIVE {CHAIN_SQL}, rules AS (SELECT library, name, 'p' || substr(name, 2) AS param, 'deprecated' AS kind, 'since ' || name AS message FROM symbols),
    delegates AS (SELECT library, name AS caller, source AS callee, 'p' || replace(replace(name, 'also', ''), 'n', '') AS param, 'p' || substr(source, 2) AS callee_param FROM aliases
      WHERE name NOT LIKE 'also%' OR substr(name, 5)::INTEGER % 20 = 0),
    walk(library, name, param, here, here_param, far) AS (
      SELECT library, name, param, name, param, 0 FROM (SELECT library, name, param FROM rules UNION SELECT library, caller, param FROM delegates)
      UNION SELECT w.library, w.name, w.param, d.callee, d.callee_param, far + 1 FROM walk w JOIN delegates d ON d.library = w.library AND d.caller = w.here AND d.param = w.here_param
        WHERE far < 250 AND (w.library, w.here, w.here_param) NOT IN (SELECT library, name, param FROM rules))
    SELECT w.library, w.name, w.param, r.kind, arg_min(r.message, (far, r.message)) AS message
    FROM walk w JOIN rules r ON r.library = w.library AND r.name = w.here AND r.param = w.here_param GROUP BY w.library, w.name, w.param, r.kind""",
)
def propagated_contracts(spark, sf_dir):
    aliases, symbols = chains(spark, sf_dir)
    number = lambda c: F.regexp_replace(c, "[a-z]+", "p")
    delegates = aliases.where("name NOT LIKE 'also%' OR cast(substr(name, 5) AS int) % 20 = 0").select(
        "library", F.col("name").alias("caller"), F.col("source").alias("callee"), number("name").alias("param"), number("source").alias("callee_param")
    )
    rules = symbols.select("library", "name", number("name").alias("param"), F.lit("deprecated").alias("kind"), F.concat(F.lit("since "), "name").alias("message"))
    return graph.propagate_contracts(rules, delegates)

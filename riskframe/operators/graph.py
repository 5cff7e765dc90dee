"""Graph operators as rounds of joins.

Each round joins only what the last round found, removes what is known and writes what is new as a table, whose size
tells the planner whether it may be broadcast; the loop ends when a round finds nothing. Labels travel instead of node pairs wherever a question allows it, so results stay linear in the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.lookup import lookup
from riskframe.functions.paths import is_test_path
from riskframe.session import cut_lineage, stage

MERGE_EVERY = 8
HOPS = 8
REACH_ORDER = {"entrypoint": 0, "reachable": 1, "test_only": 2, "unreferenced": 3, "n/a": 4}


def spread(seeds: DataFrame, edges: DataFrame, source: str, target: str, keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """Everything labels reach along edges.

    ``seeds(keys…, source, label…)`` start; an edge ``(keys…, source, target)`` carries a node's labels to ``target``.
    The result has the same columns as the seeds and includes them. Each round writes only what it found; the rounds so
    far are merged into one table from time to time.
    """
    columns = seeds.columns
    links = stage(edges.select(*keys, source, target).where(F.col(source) != F.col(target)).distinct())
    known = frontier = stage(seeds.distinct())
    rounds = 0
    while not frontier.isEmpty() and (max_rounds is None or rounds < max_rounds):
        moved = frontier.join(links, [*keys, source]).drop(source).withColumnRenamed(target, source).select(*columns)
        frontier = stage(moved.distinct().join(known, columns, "left_anti"))
        known = known.unionByName(frontier)
        rounds += 1
        if rounds % MERGE_EVERY == 0:
            known = stage(known)
    return known


def spread_best(seeds: DataFrame, edges: DataFrame, source: str, target: str, keys: list[str]) -> DataFrame:
    """The highest rank each node receives along edges: ``(keys…, source, rank)``.

    Only edges into nodes that a seed doesn't give the top rank are followed, each with the rank its target starts from: a
    rank is passed on only where it is higher. Each round follows ``HOPS`` edges in one job before it compares with what
    earlier rounds raised; a graph of n levels takes n / HOPS rounds. Nodes no round raised are never written again.
    """
    node = [*keys, source]
    best = F.max("rank").alias("rank")
    known = stage(seeds.groupBy(*node).agg(best))
    top = known.agg(best).first()["rank"]
    begun = known.select(*keys, F.col(source).alias(target), F.col("rank").alias("_begun"))
    links = edges.select(*node, target).where(F.col(source) != F.col(target)).distinct()
    into = links.join(begun, [*keys, target], "left").where(F.col("_begun").isNull() | (F.col("_begun") < F.lit(top)))
    followed = stage(into)
    frontier, raised = known, None
    while not frontier.isEmpty():
        hop, hops = frontier, None
        for _ in range(HOPS):
            over = hop.join(followed, node).where(F.col("_begun").isNull() | (F.col("rank") > F.col("_begun")))
            hop = over.groupBy(*keys, F.col(target).alias(source)).agg(best)
            hops = hop if hops is None else hops.unionByName(hop)
        offered = hops.groupBy(*node).agg(best)
        if raised is not None:
            held = raised.groupBy(*node).agg(F.max("rank").alias("_held"))
            offered = offered.join(held, node, "left").where(F.col("_held").isNull() | (F.col("rank") > F.col("_held"))).drop("_held")
        frontier = stage(offered)
        raised = frontier if raised is None else raised.unionByName(frontier)
    return known if raised is None else known.unionByName(raised).groupBy(*node).agg(best)


def transitive_importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """All direct and indirect importers of the given files: ``repo_id, path, importer``. Cycles are fine.

    ``edges(repo_id, importer, path)``; ``files(repo_id, path)`` are the files asked about.
    """
    seeds = files.select("repo_id", F.col("path").alias("node"), F.col("path").alias("origin")).distinct()
    reversed_edges = edges.select("repo_id", F.col("path").alias("node"), F.col("importer").alias("up"))
    found = spread(seeds, reversed_edges, "node", "up", ["repo_id"])
    direct_self = reversed_edges.where(F.col("node") == F.col("up"))
    self_loops = direct_self.select("repo_id", F.col("node").alias("path"), F.col("up").alias("importer"))
    out = found.where(F.col("node") != F.col("origin")).select(
        "repo_id", F.col("origin").alias("path"), F.col("node").alias("importer")
    )
    return out.unionByName(self_loops.join(files, ["repo_id", "path"], "left_semi")).distinct()


def _hashed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a hash of a path as the first key of joins: paths begin alike, so sorting by them compares whole texts."""
    return df.withColumn("_h", F.xxhash64(column))


def reach_of_files(files: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """How far production can get to each Python file: entrypoint, reachable, test_only or unreferenced.

    One rank travels from importers to what they import: an entry point's, a production module's or a test's. A node
    keeps the best rank it receives, so no importer pairs are built. Nodes get numbers first: the rounds move no paths.
    ``files(repo_id, path)``, ``edges(repo_id, importer, path)``, ``entrypoints(repo_id, path)``.
    """
    key = ["_h", "repo_id", "node"]
    links = edges.select("repo_id", F.col("importer").alias("node"), F.col("path").alias("imported")).dropna()
    ends = links.select("repo_id", "node").unionByName(links.select("repo_id", F.col("imported").alias("node")))
    entries = entrypoints.select("repo_id", F.col("path").alias("node")).distinct().withColumn("_entry", F.lit(True))
    production = ~is_test_path(F.col("node"))
    rank = F.when(production & F.coalesce("_entry", F.lit(False)), 3).when(production, 2).otherwise(1)
    nodes = _hashed(ends, "node").distinct().join(_hashed(entries, "node"), key, "left")
    numbered = stage(nodes.select(*key, rank.alias("rank"), F.monotonically_increasing_id().alias("id")))
    # A file's own rank is not about itself: it starts at what the file imports.
    started = _hashed(links, "node").join(numbered.withColumnRenamed("id", "a"), key).select(
        F.xxhash64("imported").alias("_h"), "repo_id", F.col("imported").alias("node"), "a", "rank"
    )
    steps = stage(started.join(numbered.drop("rank"), key).select("a", F.col("id").alias("b"), "rank"))
    best = spread_best(steps.select(F.col("b").alias("a"), "rank"), steps.select("a", "b"), "a", "b", [])
    named = numbered.drop("rank").join(best.withColumnRenamed("a", "id"), "id").select("_h", "repo_id", F.col("node").alias("path"), "rank")
    reach = (
        F.when(~F.col("path").endswith(".py"), F.lit("n/a"))
        .when(F.coalesce("_self", F.lit(False)) | (F.col("rank") == 3), F.lit("entrypoint"))
        .when(F.col("rank") == 2, F.lit("reachable"))
        .when(F.col("rank") == 1, F.lit("test_only"))
        .otherwise(F.lit("unreferenced"))
    )
    place = ["_h", "repo_id", "path"]
    own_entry = _hashed(entrypoints.select("repo_id", "path").distinct(), "path").withColumn("_self", F.lit(True))
    return (
        _hashed(files.select("repo_id", "path"), "path")
        .join(named, place, "left")
        .join(own_entry, place, "left")
        .select("repo_id", "path", reach.alias("reach"))
    )


def best_reach(members: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """The best reach among the files of each key; ``members(keys…, repo_id, path)``."""
    rank = lookup(F.col("reach"), REACH_ORDER, 9)
    names = F.array(*[F.lit(name) for name in REACH_ORDER])
    found = _hashed(members, "path").join(_hashed(reach, "path"), ["_h", "repo_id", "path"])
    return found.groupBy(*keys).agg(F.min(rank).alias("_rank")).select(*keys, F.get(names, F.col("_rank")).alias("reach"))


def best_reach_of_members(members: DataFrame, edges: DataFrame, entrypoints: DataFrame, keys: list[str]) -> DataFrame:
    """The best reach among the files of each key, ``members(keys…, repo_id, path)``; the graph is walked only where it can matter.

    Nothing is better than an entry point: a key has its answer with one among its own files, or with a file that one
    imports. Only if other keys are left are all edges followed, and the files of these keys looked up.
    """
    place = ["repo_id", "path"]
    left = members.where(F.col("repo_id").isNotNull() & F.col("path").isNotNull())
    entries = entrypoints.select(*place).distinct()
    production = entries.where(~is_test_path(F.col("path"))).withColumnRenamed("path", "importer")
    imported = edges.join(production, ["repo_id", "importer"], "left_semi").select(*place)
    settled = None
    for top in (entries, imported):
        found = stage(left.join(top.where(F.col("path").endswith(".py")).distinct(), place, "left_semi").select(*keys).distinct())
        settled = found if settled is None else settled.unionByName(found)
        open_keys = stage(left.select(*keys).distinct().subtract(found))
        if open_keys.isEmpty():
            return settled.withColumn("reach", F.lit("entrypoint"))
        # Null keys are keys as well. Each round's members are written: the next one reads only what is left.
        named = open_keys.select(*[F.col(k).alias(f"_{k}") for k in keys])
        left = stage(left.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi").distinct())
    reach = reach_of_files(left.select(*place).distinct(), stage(edges), entrypoints)
    return settled.withColumn("reach", F.lit("entrypoint")).unionByName(best_reach(left, reach, keys))


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as ``(node, component)``; a component is named by its smallest node.

    Alternates the large-star and small-star steps, which hang every node below smaller ones and converge in a
    logarithmic number of rounds, whatever the diameter. Neighbourhoods are never collected: each step is one minimum per
    node joined back to the edges.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = both.select(F.col("u").alias("node")).unionByName(both.select(F.col("v").alias("node"))).distinct()
    current = cut_lineage(both.where(F.col("u") != F.col("v")).distinct())
    previous = None
    while True:
        two_way = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        smallest = two_way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two_way.join(smallest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        current = cut_lineage(small.where(F.col("u") != F.col("v")).distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    parents = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(parents, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def longest_prefix_match(names: DataFrame, modules: DataFrame, name: str = "target") -> DataFrame:
    """Resolve dotted names to modules by their longest prefix; ``path`` is null where no prefix is a module.

    ``names(repo_id, …, target)``, ``modules(repo_id, module, path)``. Prefixes are equi-joined, the longest wins.
    """
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("module"))
    )
    distinct = names.select("repo_id", name).distinct()
    hits = (
        distinct.select("repo_id", name, F.inline(prefixes))
        .join(modules, ["repo_id", "module"])
        .groupBy("repo_id", name)
        .agg(F.max_by(F.struct("module", "path"), "n").alias("_m"))
    )
    return names.join(hits, ["repo_id", name], "left").withColumns(
        {"module": F.col("_m.module"), "module_path": F.col("_m.path")}
    ).drop("_m")


def import_graph(imports: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Internal edges ``(repo_id, importer, path)`` and external imports ``(repo_id, path, root)``.

    ``imports(repo_id, path, target)`` are facts of files, ``modules(repo_id, module, path)`` the files' module names.
    """
    resolved = longest_prefix_match(imports, modules)
    own = modules.select("repo_id", F.col("path"), F.col("module").alias("_own"))
    internal = (
        resolved.where(F.col("module").isNotNull())
        .join(own, ["repo_id", "path"], "left")
        .where(~F.coalesce(F.col("_own") == F.col("module"), F.lit(False)))
        .select("repo_id", F.col("path").alias("importer"), F.col("module_path").alias("path"))
        .distinct()
    )
    external = (
        resolved.where(F.col("module").isNull() & (F.col("target") != ""))
        .select("repo_id", "path", F.split_part("target", F.lit("."), F.lit(1)).alias("root"))
        .distinct()
    )
    return internal, external


def untested_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Production modules that no test imports."""
    test_edges = edges.where(is_test_path(F.col("importer"))).select("repo_id", "path").distinct()
    production = files.where(
        F.col("path").endswith(".py") & ~is_test_path(F.col("path")) & ~F.col("path").endswith("__init__.py")
    ).select("repo_id", "path")
    return production.join(test_edges, ["repo_id", "path"], "left_anti")


def inherited_members(classes: DataFrame, members: DataFrame, vanished: DataFrame) -> DataFrame:
    """Vanished members a class still inherits; walks the bases of the class by their last names.

    ``classes(library, name, bases)``, ``members(library, holder, member)``, ``vanished(library, owner, member)``.
    """
    tail = F.element_at(F.split(F.col("name"), r"\."), -1)
    up = classes.select(
        "library",
        tail.alias("node"),
        F.explode(F.transform("bases", lambda b: F.element_at(F.split(b, r"\."), -1))).alias("base"),
    )
    own = classes.select("library", F.col("name").alias("origin"), F.explode(
        F.transform("bases", lambda b: F.element_at(F.split(b, r"\."), -1))
    ).alias("node"))
    wanted = vanished.select("library", F.col("owner").alias("origin")).distinct()
    reached = spread(own.join(wanted, ["library", "origin"], "left_semi").select("library", "node", "origin"), up, "node", "base", ["library"])
    holders = members.select("library", F.element_at(F.split("holder", r"\."), -1).alias("node"), "member").distinct()
    return (
        reached.join(holders, ["library", "node"])
        .select("library", F.col("origin").alias("owner"), "member")
        .join(vanished, ["library", "owner", "member"], "left_semi")
        .distinct()
    )


def _doublings(pairs: DataFrame, node: list[str], keys: list[str]) -> int:
    """Rounds after which no path without a circle is longer than the pairs doubled so often. Paths stay within their ``keys``."""
    longest = pairs.select(*keys, *node).distinct().groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (longest or 0).bit_length()


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts both sides: a staged table's files are far smaller than its rows, too small a measure for a broadcast."""
    return df.hint("merge")


def follow_aliases(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve re-exported names to the symbols behind them: ``library, name, target``.

    ``aliases(library, name, source)``, ``symbols(library, name)``. Pointers are doubled: a name that still points at an alias
    takes over where that one points to, so chains of n steps take log2(n) rounds, and each round writes only the pointers it
    moved. Names that only lead round in a circle are still open after as many rounds as the longest possible chain of a
    library needs, and have no target.
    """
    real = symbols.select("library", F.col("name").alias("at"), F.lit(True).alias("_real")).distinct()
    step = aliases.select("library", "name", F.col("source").alias("at")).distinct().join(_merged(real), ["library", "at"], "left")
    moved = stage(step.select("library", "name", "at", F.coalesce("_real", F.lit(False)).alias("_real")))
    done, pending = moved.where("_real"), moved.where("NOT _real")
    for _ in range(_doublings(pending, ["name"], ["library"])):
        if pending.isEmpty():
            break
        onward = done.unionByName(pending).select("library", F.col("name").alias("at"), F.col("at").alias("_on"), "_real")
        over = pending.select("library", "name", "at").join(_merged(onward), ["library", "at"])
        moved = stage(over.select("library", "name", F.col("_on").alias("at"), "_real").distinct())
        done, pending = done.unionByName(moved.where("_real")), moved.where("NOT _real")
    return done.select("library", "name", F.col("at").alias("target")).distinct()


def propagate_contracts(rules: DataFrame, delegates: DataFrame) -> DataFrame:
    """Rules on a callee's parameter hold for callers that forward their own argument to it; the nearest message stays, of several the least.

    ``rules(library, name, param, kind, message)``, ``delegates(library, caller, callee, param, callee_param)``. A forwarded
    parameter is a node, renamed on each step; steps are doubled, so a chain of n callers takes log2(n) rounds, and each
    rule carries how far away it was stated. Callers that forward to each other in a circle end with the rounds.
    """
    node = ["library", "name", "param"]
    steps = stage(
        delegates.where(F.col("caller") != F.col("callee"))
        .select("library", F.col("caller").alias("name"), "param", F.col("callee").alias("_name"), F.col("callee_param").alias("_param"))
        .distinct()
    )
    held = stage(rules.select(*node, "kind", "message", F.lit(0).cast("long").alias("_far")))
    stated = held
    for round_ in range(_doublings(steps, ["name", "param"], ["library"])):
        if steps.isEmpty():
            break
        behind = held.select("library", F.col("name").alias("_name"), F.col("param").alias("_param"), "kind", "message", "_far")
        over = steps.join(_merged(behind), ["library", "_name", "_param"]).select(*node, "kind", "message", (F.col("_far") + (1 << round_)).alias("_far"))
        nearest = F.min(F.struct("_far", "message")).alias("_best")
        inherited = over.unionByName(held.where("_far > 0")).groupBy(*node, "kind").agg(nearest)
        kept = inherited.select(*node, "kind", "_best.message", "_best._far").join(_merged(stated), [*node, "kind"], "left_anti")
        held = stage(stated.unionByName(kept))
        onward = steps.select("library", F.col("name").alias("_name"), F.col("param").alias("_param"), F.col("_name").alias("_n"), F.col("_param").alias("_p"))
        steps = stage(steps.join(_merged(onward), ["library", "_name", "_param"]).select(*node, F.col("_n").alias("_name"), F.col("_p").alias("_param")).distinct())
    return held.drop("_far")

import random

import pytest

from riskframe.operators import graph


@pytest.mark.parametrize("length", [1, 3, 70, 200])
def test_alias_chains_of_any_length(spark, length):
    rows = [("lib", f"n{i + 1}", f"n{i}") for i in range(length)] + [("lib", "a", "b"), ("lib", "b", "a"), ("lib", "c", "gone")]
    symbols = spark.createDataFrame([("lib", "n0"), ("other", "a")], "library string, name string")
    got = {(r.name, r.target) for r in graph.follow_aliases(spark.createDataFrame(rows, "library string, name string, source string"), symbols).collect()}
    assert got == {(f"n{i + 1}", "n0") for i in range(length)}


def test_aliases_of_several_sources_stop_at_the_first_symbol(spark):
    rows = [("l", "x", "y"), ("l", "x", "z"), ("l", "y", "s"), ("l", "z", "t"), ("l", "s", "t")]
    symbols = spark.createDataFrame([("l", "s"), ("l", "t")], "library string, name string")
    got = {(r.name, r.target) for r in graph.follow_aliases(spark.createDataFrame(rows, "library string, name string, source string"), symbols).collect()}
    assert got == {("x", "s"), ("x", "t"), ("y", "s"), ("z", "t"), ("s", "t")}


def slow_contracts(rules, delegates):
    held = {(n, p, k): m for n, p, k, m in rules}
    while True:
        new = {}
        for caller, callee, mine, theirs in delegates:
            for (name, param, kind), message in held.items():
                if caller != callee and (name, param) == (callee, theirs) and (caller, mine, kind) not in held:
                    key = (caller, mine, kind)
                    new[key] = min(new.get(key, message), message)
        if not new:
            return held
        held |= new


def test_contracts_against_rounds_of_one_hop(spark):
    rng = random.Random(9)
    for size in (6, 25):
        names = [f"f{i}" for i in range(size)]
        delegates = list({(rng.choice(names), rng.choice(names), rng.choice("pq"), rng.choice("pq")) for _ in range(2 * size)})
        rules = list({(n, p, k): (n, p, k, f"m{rng.randrange(5)}") for n, p, k in {(rng.choice(names), rng.choice("pq"), rng.choice("dr")) for _ in range(4)}}.values())
        got = graph.propagate_contracts(
            spark.createDataFrame([("l", n, p, k, m) for n, p, k, m in rules], "library string, name string, param string, kind string, message string"),
            spark.createDataFrame([("l", *d) for d in delegates], "library string, caller string, callee string, param string, callee_param string"),
        ).collect()
        assert {(r.name, r.param, r.kind): r.message for r in got} == slow_contracts(rules, delegates) and len(got) == len({(r.name, r.param, r.kind) for r in got})


def test_best_ranks_over_deep_graphs_and_circles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(40, 3), (70, 71), (71, 70)] + [(rng.randrange(60), rng.randrange(80)) for _ in range(30)]
    seeds = [(5, 1), (30, 3), (30, 2), (70, 2), (79, 1)]
    best = {}
    for node, rank in seeds:
        todo, seen = [node], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                best[x] = max(best.get(x, 0), rank)
                todo += [b for a, b in edges if a == x]
    frame = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, a int, b int")
    got = graph.spread_best(spark.createDataFrame([("r", n, k) for n, k in seeds], "repo string, a int, rank int"), frame, "a", "b", ["repo"]).collect()
    assert {r.a: r["rank"] for r in got} == best and len(got) == len(best)


def test_rounds_write_only_what_can_still_rise(spark, monkeypatch):
    written = []
    keep = graph.stage

    def counted(df):
        kept = keep(df)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "stage", counted)
    edges = spark.createDataFrame([("r", f"n{i}", f"n{i // 2}") for i in range(1, 200)], "repo string, a string, b string")
    seeds = spark.createDataFrame([("r", f"n{i}", 1 if i == 3 else 2) for i in range(100)], "repo string, a string, rank int")
    got = {r.a: r["rank"] for r in graph.spread_best(seeds, edges, "a", "b", ["repo"]).collect()}
    assert got == {f"n{i}": 2 for i in range(100)}
    # The nodes once, the two edges into the one node below the top, that node, and a round that finds nothing.
    assert written == [100, 2, 1, 0]


def test_staged_tables_are_not_broadcast_for_their_small_files(spark, monkeypatch):
    plans = []
    keep = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = [("lib", f"n{i + 1}", f"n{i}") for i in range(9)]
    symbols = spark.createDataFrame([("lib", "n0")], "library string, name string")
    found = graph.follow_aliases(spark.createDataFrame(rows, "library string, name string, source string"), symbols)
    assert {r.target for r in found.collect()} == {"n0"}
    rules = spark.createDataFrame([("lib", "n0", "p", "deprecated", "m")], "library string, name string, param string, kind string, message string")
    steps = spark.createDataFrame([(*r, "p", "p") for r in rows], "library string, caller string, callee string, param string, callee_param string")
    assert graph.propagate_contracts(rules, steps).count() == 10
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_alias_rounds_follow_the_longest_library_and_write_only_what_moved(spark, monkeypatch):
    written = []
    keep = graph.stage

    def counted(df):
        kept = keep(df)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "stage", counted)
    # Forty libraries, each with a circle of three names and a chain of three to a symbol.
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("z", "y"), ("y", "x"), ("x", "s")]
    aliases = spark.createDataFrame([(f"l{i}", *p) for i in range(40) for p in pairs], "library string, name string, source string")
    symbols = spark.createDataFrame([(f"l{i}", "s") for i in range(40)], "library string, name string")
    got = graph.follow_aliases(aliases, symbols).collect()
    assert sorted((r.library, r.name, r.target) for r in got) == sorted((f"l{i}", n, "s") for i in range(40) for n in "xyz")
    # Of each library all six pointers; the five not at the symbol yet; the circle and "z"; the circle, which the third round leaves open.
    assert written == [240, 200, 160, 120]


def test_aliases_against_single_steps(spark):
    rng = random.Random(4)
    for size in (5, 18):
        names = [f"n{i}" for i in range(size)]
        libraries = ("p", "q", None)
        rows = [(rng.choice(libraries), rng.choice(names), rng.choice([*names, None])) for _ in range(3 * size)]
        real = {(rng.choice(libraries[:2]), rng.choice(names)) for _ in range(4)}
        want = set()
        for library, name, source in rows:
            todo, seen = [source], set()
            while todo and library is not None:
                here = todo.pop()
                if here is None or here in seen:
                    continue
                seen.add(here)
                if (library, here) in real:
                    want.add((library, name, here))
                else:
                    todo += [s for lib, n, s in rows if (lib, n) == (library, here)]
        got = graph.follow_aliases(
            spark.createDataFrame(rows, "library string, name string, source string"), spark.createDataFrame([*real, *real], "library string, name string")
        ).collect()
        assert sorted((r.library, r.name, r.target) for r in got) == sorted(want)


def test_contract_rounds_follow_the_longest_library(spark, monkeypatch):
    written = []
    keep = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: written.append(df) or keep(df))
    steps = [(f"l{i}", a, b, p, q) for i in range(40) for a, b, p, q in [("a", "b", "p", "q"), ("b", "a", "q", "p"), ("d", "c", "r", "q"), ("c", "s", "q", "t")]]
    rules = spark.createDataFrame([(f"l{i}", "s", "t", "deprecated", "m") for i in range(40)], "library string, name string, param string, kind string, message string")
    got = graph.propagate_contracts(rules, spark.createDataFrame(steps, "library string, caller string, callee string, param string, callee_param string")).collect()
    assert sorted((r.library, r.name, r.param) for r in got) == sorted((f"l{i}", *x) for i in range(40) for x in [("s", "t"), ("c", "q"), ("d", "r")])
    # Steps and rules, then both in each of three rounds: four names of a library forward their parameter.
    assert len(written) == 8

import random

import pytest
from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.operators.license_rules import expression_conflict, license_findings

RANK = {"low": 1, "medium": 2, "high": 3}


def rank_of(name):
    kind = C.LICENSE_CLASS.get(name)
    return None if kind is None else RANK.get(C.LICENSE_CONFLICTS.get(("permissive", kind)), 0)


def random_tree(rng, depth=0):
    """(text, rank or None) of a random expression."""
    if depth > 3 or rng.random() < 0.35:
        name = rng.choice(["MIT", "Apache-2.0", "GPL-3.0", "AGPL-3.0", "MPL-2.0", "LGPL-3.0", "Custom-1"])
        return name, rank_of(name)
    op = rng.choice(["AND", "OR"])
    parts = [random_tree(rng, depth + 1) for _ in range(rng.randrange(2, 4))]
    ranks = [r for _, r in parts if r is not None]
    value = None if not ranks else (max if op == "AND" else min)(ranks)
    return "(" + f" {op} ".join(t for t, _ in parts) + ")", value


def test_expressions_as_trees(spark):
    rng = random.Random(6)
    cases = [random_tree(rng) for _ in range(300)]
    cases += [
        ("MIT OR GPL-3.0 AND AGPL-3.0", 0),
        ("GPL-3.0 AND MIT OR MPL-2.0", 1),
        ("MPL-2.0 / GPL-3.0", 1),
        ("GPL-3.0, MIT", 0),
        ("(GPL-3.0 AND (MIT", 3),
        ("GPL-3.0)", 3),
        ("", 0),
        (None, 0),
        ("OR", 0),
        ("Custom-1 AND GPL-3.0", 3),
    ]
    rows = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(cases)], "i int, e string")
    got = {r.i: r.s for r in rows.select("i", expression_conflict(F.lit("MIT"), F.col("e")).alias("s")).collect()}
    names = {v: k for k, v in RANK.items()}
    assert [got[i] for i in range(len(cases))] == [names.get(r) for _, r in cases]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy. THE SOFTWARE IS PROVIDED \"AS IS\""
GPL = "# SPDX-License-Identifier: GPL-3.0\nx = 1\n"


@pytest.fixture
def tables(spark):
    files = [
        ("a", "LICENSE", MIT),
        ("a", "pyproject.toml", '[build]\nlicense = "no"\n[project]\nname = "a"\nlicense = {text = "Apache-2.0"}\n'),
        ("a", "package.json", '{"license": "MIT"}'),
        ("a", "src/x.py", GPL),
        ("a", "src/y.py", GPL),
        ("a", "z.md", GPL),
        ("b", "docs/LICENSE", MIT),
        ("b", "Cargo.toml", '[package]\nname = "b"\nlicense = "MIT"\n'),
        ("b", "package.json", '{"license": "ISC"}'),
        ("c", "COPYING.md", "unheard-of terms"),
        ("c", "x.py", GPL),
        ("d", "package.json", '{"license": {"type": "GPL-3.0"}}'),
    ]
    deps = [
        ("a", "one", "r.txt", "ok", "GPL-3.0 OR MIT"),
        ("a", "two", "r.txt", "ok", "GPL-3.0 AND MIT"),
        ("a", "two", "r.txt", "ok", "GPL-3.0 AND MIT"),
        ("a", "three", "r.txt", "missing", "GPL-3.0"),
        ("a", "four", "r.txt", "ok", None),
        ("c", "five", "r.txt", "ok", "GPL-3.0"),
    ]
    return (
        spark.createDataFrame([(r,) for r in "abcde"], "repo_id string"),
        spark.createDataFrame(files, "repo_id string, path string, text string"),
        spark.createDataFrame(deps, "repo_id string, name string, manifest string, registry_status string, registry_license string"),
    )


def test_four_rules(tables):
    got = sorted((r.repo_id, r.rule_id.split(".")[1], r.subject, r.severity, r.affected_files) for r in license_findings(*tables).collect())
    assert got == [
        ("a", "copyleft_file", "license-file:GPL-3.0", "high", ["src/x.py", "src/y.py"]),
        ("a", "dependency_incompatible", "pkg:two", "high", ["r.txt"]),
        ("a", "metadata_mismatch", "license:project", "medium", ["LICENSE", "pyproject.toml"]),
        ("b", "metadata_mismatch", "license:project", "medium", ["Cargo.toml", "LICENSE"]),
        ("b", "missing", "license:project", "medium", []),
        ("d", "missing", "license:project", "medium", []),
        ("e", "missing", "license:project", "medium", []),
    ]


def test_empty_tables(tables):
    repositories, files, deps = tables
    assert license_findings(repositories.where("false"), files.where("false"), deps.where("false")).count() == 0

"""Facts by kind: the same rows as picked from all facts, from one pass that grows with the files."""

from __future__ import annotations

import pytest

from riskframe.operators import code_rules
from riskframe.plans.code import FILES_PER_TASK, parse_tasks
from riskframe.sources.pyfacts import KINDS, file_facts, python_facts

SOURCE = '''
import os, yaml as y
from requests import get as fetch
DEBUG = True
class Store(Base):
    def __init__(self):
        self.db = Engine()
    def test_it(self, *a, k=1, **kw):
        """Doc."""
        for row in self.db.query(a):
            with open(row) as f, lock:
                y.load(f) if k and a else [fetch(u, verify=False) for u in a if u or k]
        try:
            match k:
                case {"x": 1, **rest} if rest: warnings.warn("old", DeprecationWarning)
        except Exception:
            pass
        return lambda z=os.environ.get("A_TOKEN", "x"): z
store = Store()
loader = y.SafeLoader
again = store.test_it
'''


def plain(facts):
    return [sorted(f.items(), key=lambda kv: kv[0]) for f in facts]


@pytest.mark.parametrize("kinds", [[k] for k in KINDS] + [["call", "debug"], ["test", "call"], ["import", "call", "reference"]])
def test_facts_of_some_kinds_are_those_of_all(kinds):
    every = list(file_facts("pkg/settings.py", SOURCE))
    assert {f["fact"] for f in every} == set(KINDS)
    assert plain(file_facts("pkg/settings.py", SOURCE, kinds)) == plain(f for f in every if f["fact"] in kinds)


def test_columns_that_no_kind_fills_are_null(spark):
    files = spark.createDataFrame([("r", "pkg/settings.py", SOURCE)], "repo_id string, path string, text string")
    row = python_facts(files, ["function"]).where("name = 'Store.test_it'").first()
    assert (row.complexity, row.nesting, row.n_params, row.flags) == (9, 2, 4, ["warns"])
    assert row.params is None and row.keywords is None


def test_rules_on_two_kinds_parse_every_file_once(spark):
    files = spark.createDataFrame([("r", "pkg/settings.py", SOURCE), ("r", "tests/test_a.py", SOURCE)], "repo_id string, path string, text string")
    facts = python_facts(files)
    hits, quality = code_rules.insecure_calls(facts), code_rules.test_findings(facts)
    for found in (hits, quality):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.rule_id.split(".")[1], r.path, r.line) for r in hits.collect()} == {
        ("debug_enabled", "pkg/settings.py", 4),
        ("yaml_unsafe_load", "pkg/settings.py", 12),
        ("tls_verification_disabled", "pkg/settings.py", 12),
        ("hardcoded_default_secret", "pkg/settings.py", 18),
    }
    assert [(r.rule_id, r.path) for r in quality.collect()] == [("testing.no_assertions", "tests/test_a.py")]


def test_parsing_tasks_grow_with_the_files_whatever_cores_are_known():
    assert parse_tasks(9_000_000, 2) == 9_000_000 // FILES_PER_TASK
    assert parse_tasks(1, 8) == 8

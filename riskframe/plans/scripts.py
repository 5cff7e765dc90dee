"""Queries on script sources. The driver has none, so Spark writes one small file per key, of several templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import scripts
from riskframe.plans.registry import query
from riskframe.sources.adapters import table

# {k} is the key. Each template with its exports: (name, kind, line, parameters, deprecated).
LIBRARY_FILES = (
    (
        "export function fn{k}(a, { b = {k}, c: [d] } = {}, e = g(1, (2, 3))) {}\n",
        [("fn{k}", "function", 1, "a:pos:-|{…}:pos:{}|e:pos:g(1, (2, 3))", False)],
    ),
    (
        "/** @deprecated use other */\nexport const fn{k} = async (m: Map<string, number>, n?: string, ...rest) => m;\n",
        [("fn{k}", "function", 2, "m:pos:-|n:pos:undefined|rest:var:-", True)],
    ),
    (
        "// export function no{k}(x) {}\nmodule.exports.fn{k} = function (cb, s = 'a, {k}') {};\n",
        [("fn{k}", "function", 2, "cb:pos:-|s:pos:'a, {k}'", False)],
    ),
    (
        "export class fn{k} extends B {}\nexport { x{k} as y{k}, z{k} };\n",
        [("fn{k}", "class", 1, None, False), ("y{k}", "export", 2, None, False), ("z{k}", "export", 2, None, False)],
    ),
    (
        "export function fn{k}(a, [b, c] = [{k}, 2], d = (x, y) => x) {}\nexport function open{k}(a, (b\n",
        [("fn{k}", "function", 1, "a:pos:-|[…]:pos:[{k}, 2]|d:pos:(x, y) => x", False), ("open{k}", "function", 2, None, False)],
    ),
)
# {k} is the key, {m} the key modulo 7. Each template with its usages: (line, kind, symbol, positional).
PROJECT_FILES = (
    (
        "import { get as fetch } from 'lib{m}/client';\nfetch('/a', { x: [1, 2] }, (a, b) => a);\n",
        [(1, "import", "lib{m}.get", None), (2, "call", "lib{m}.get", 3)],
    ),
    (
        "const lib = require('lib{m}');\nlib.run(lib.id({k}), 2);\nlib.flag;\n",
        [(1, "import", "lib{m}", None), (2, "call", "lib{m}.run", 2), (2, "call", "lib{m}.id", 1), (3, "reference", "lib{m}.flag", None)],
    ),
    (
        'const { put: send } = require("lib{m}");\n// send(1)\nsend(`a, ${x}`, );\nother.send(1, 2);\n',
        [(1, "import", "lib{m}.put", None), (3, "call", "lib{m}.put", 1)],
    ),
    (
        "import main, * as ns from 'lib{m}';\nns.a.b(1);\nmain(ns.c(), [1, 2]);\nns.open(1, (2\n",
        [
            (1, "import", "lib{m}", None),
            (2, "reference", "lib{m}.a", None),
            (3, "call", "lib{m}.default", 2),
            (3, "call", "lib{m}.c", 0),
            (4, "call", "lib{m}.open", None),
        ],
    ),
    ("import * as ns from 'other';\nns.go({k});\n", []),
)


def _text(templates, key) -> F.Column:
    out = None
    for i, (text, _) in enumerate(templates):
        filled = F.replace(F.replace(F.lit(text), F.lit("{k}"), key.cast("string")), F.lit("{m}"), (key % 7).cast("string"))
        hit = key % len(templates) == i
        out = F.when(hit, filled) if out is None else out.when(hit, filled)
    return out


def _sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        quoted = "'" + value.replace("'", "''") + "'"
        return f"replace(replace({quoted}, '{{k}}', k::VARCHAR), '{{m}}', (k % 7)::VARCHAR)" if "{" in value else quoted
    return str(value).lower()


def _sql_rows(templates, head: str, columns: tuple[str, ...], source: str) -> str:
    parts = [
        f"SELECT {head}, " + ", ".join(f"{_sql_value(v)} AS {c}" for v, c in zip(row, columns, strict=True)) + f" FROM {source} WHERE k % {len(templates)} = {i}"
        for i, (_, rows) in enumerate(templates)
        for row in rows
    ]
    return " UNION ALL ".join(parts)


def library_files(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg"), (key % 20).cast("string")).alias("repo_id"),
        F.concat(F.lit("src/f"), key.cast("string"), F.lit(".ts")).alias("path"),
        _text(LIBRARY_FILES, key).alias("text"),
    )


def project_files(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("repo_id"),
        F.concat(F.lit("app/u"), key.cast("string"), F.lit(".js")).alias("path"),
        _text(PROJECT_FILES, key).alias("text"),
    )


@query(
    "script_exports_of_files",
    "WITH src AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 20) AS library, 'src/f' || p_partkey || '.ts' AS file FROM part), found AS ("
    + _sql_rows(LIBRARY_FILES, "library, file", ("export", "kind", "line", "params", "deprecated"), "src")
    + ") SELECT library, library || '.' || export AS name, kind, file, line::INTEGER AS line, params, deprecated FROM found",
)
def script_exports_of_files(spark, sf_dir):
    shown = F.transform("params", lambda p: F.concat_ws(":", p["name"], p["kind"], F.coalesce(p["default"], F.lit("-"))))
    rows = scripts.script_exports(library_files(spark, sf_dir))
    return rows.withColumn("params", F.when(F.col("params").isNotNull(), F.array_join(shown, "|")))


@query(
    "script_call_sites",
    "WITH src AS (SELECT o_orderkey AS k, CAST(o_custkey % 50 AS VARCHAR) AS project_id, 'lib' || (o_orderkey % 7) AS library, 'app/u' || o_orderkey || '.js' AS file FROM orders), found AS ("
    + _sql_rows(PROJECT_FILES, "project_id, library, file", ("line", "usage_kind", "symbol", "n_args"), "src")
    + ") SELECT project_id, library, file, line::INTEGER AS line, usage_kind, symbol, n_args::INTEGER AS args FROM found",
)
def script_call_sites(spark, sf_dir):
    packages = table(spark, sf_dir, "orders").select(F.concat(F.lit("lib"), (F.col("o_orderkey") % 7).cast("string")).alias("library"))
    return scripts.script_usages(project_files(spark, sf_dir), packages).withColumnRenamed("positional", "args")

"""Queries on code facts. The driver has no source code, so Spark writes one small module per order from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.paths import is_test_path
from riskframe.operators import code_rules, graph
from riskframe.plans.registry import query
from riskframe.session import stage
from riskframe.sources.adapters import table
from riskframe.sources.pyfacts import python_facts

# Order k: one function with k % 6 nested branches in a loop, a call chosen by k % 6, an import of the module of k / 2.
CALLS = ("jwt.decode(x, verify=False)", "jwt.decode(x)", "hashlib.md5(x)", "yaml.load(x)", "db.execute('q' % x)", "requests.get(x)")
# Files a task parses, a few seconds of work: the tasks grow with the table and don't hang on the cores known at planning.
FILES_PER_TASK = 20_000
RULES = ("jwt_verification_disabled", "jwt_no_algorithms", "", "yaml_unsafe_load", "sql_injection", "")


def parse_tasks(files: int, cores: int) -> int:
    """Executors may still be registering when a query is planned: ``cores`` is the least, the number of files decides."""
    return max(cores, -(-files // FILES_PER_TASK))


def source_files(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    folder = F.when(key % 9 == 0, F.lit("tests/test_m")).otherwise(F.lit("pkg/m"))
    call = F.element_at(F.array(*[F.lit(c) for c in CALLS]), (key % 6 + 1).cast("int"))
    pad = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    depth = key % 6
    branches = F.array_join(
        F.transform(F.sequence(F.lit(0), depth.cast("int")), lambda i: F.when(i > 0, F.concat(pad(4 + 4 * i), F.lit("if i and x:\n"))).otherwise(F.lit(""))),
        "",
    )
    text = F.concat(
        F.lit("import jwt, hashlib, yaml, requests\nfrom pkg import m"),
        F.floor(key / 2).cast("string"),
        F.lit("\n\n\ndef test_fn(x):\n    for i in x:\n"),
        branches,
        pad(8 + 4 * depth),
        call,
        F.when(key % 7 == 0, F.lit("\n    try:\n        pass\n    except Exception:\n        pass")).otherwise(F.lit("")),
        F.lit("\n"),
    )
    # Parsing costs far more than reading: the two key columns are spread over many tasks before the text is written.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.repartition(parse_tasks(orders.count(), spark.sparkContext.defaultParallelism))
    return orders.select(
        (F.col("o_custkey") % 50).alias("repo_id"), F.concat(folder, key.cast("string"), F.lit(".py")).alias("path"), text.alias("text")
    )


SOURCE_SQL = "src AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS repo_id, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'tests/test_m' ELSE 'pkg/m' END || o_orderkey || '.py' AS path, o_orderkey % 9 = 0 AS is_test FROM orders)"


def facts_of(spark, sf_dir, *kinds: str, tests: bool | None = None) -> DataFrame:
    """Facts of the kinds a rule reads; a rule for test files alone, or for all others, has only those parsed."""
    files = source_files(spark, sf_dir)
    of_tests = is_test_path(F.col("path"))
    return python_facts(files if tests is None else files.where(of_tests if tests else ~of_tests), kinds)


@query(
    "function_metrics",
    f"WITH {SOURCE_SQL} SELECT repo_id, path, CAST(2 + 2 * (k % 6) + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INT) AS complexity, CAST(1 + k % 6 AS INT) AS nesting FROM src",
)
def function_metrics(spark, sf_dir):
    return facts_of(spark, sf_dir, "function").select("repo_id", "path", "complexity", "nesting")


@query(
    "insecure_calls",
    f"""WITH {SOURCE_SQL} SELECT repo_id, path, 'security.' || CASE k % 6 WHEN 0 THEN 'jwt_verification_disabled' WHEN 1 THEN 'jwt_no_algorithms' WHEN 3 THEN 'yaml_unsafe_load' ELSE 'sql_injection' END AS rule_id,
      CAST(6 + k % 6 AS INT) AS first_line FROM src WHERE NOT is_test AND k % 6 IN (0, 1, 3, 4)""",
)
def insecure_calls(spark, sf_dir):
    # The module starts with two import lines and two blank ones: the loop is on line 6.
    hits = code_rules.insecure_calls(facts_of(spark, sf_dir, "call", "debug", tests=False))
    found = code_rules.findings_per_file(hits)
    return found.select("repo_id", "path", "rule_id", (F.col("first_line") - 1).alias("first_line"))


@query(
    "metric_findings",
    f"WITH {SOURCE_SQL} SELECT repo_id, path, 'code_quality.high_complexity' AS rule_id FROM src WHERE NOT is_test AND 2 + 2 * (k % 6) + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END > 10 UNION ALL SELECT repo_id, path, 'code_quality.deep_nesting' FROM src WHERE NOT is_test AND k % 6 > 3",
)
def metric_findings(spark, sf_dir):
    return code_rules.metric_findings(facts_of(spark, sf_dir, "function", tests=False)).select("repo_id", "path", "rule_id")


@query(
    "silent_handlers",
    f"WITH {SOURCE_SQL} SELECT repo_id, path, CAST(1 AS BIGINT) AS handlers FROM src WHERE NOT is_test AND k % 7 = 0",
)
def silent_handlers(spark, sf_dir):
    return code_rules.silent_handlers(facts_of(spark, sf_dir, "handler", tests=False)).select("repo_id", "path", "handlers")


@query(
    "loop_suspects",
    f"""WITH {SOURCE_SQL} SELECT repo_id, path, CASE k % 6 WHEN 4 THEN 'performance.n_plus_one' ELSE 'performance.network_in_loop' END AS rule_id, 'test_fn' AS function FROM src WHERE NOT is_test AND k % 6 IN (4, 5)""",
)
def loop_suspects(spark, sf_dir):
    return code_rules.loop_suspects(facts_of(spark, sf_dir, "call", tests=False)).select("repo_id", "path", "rule_id", "function")


@query(
    "test_quality",
    f"""WITH {SOURCE_SQL} SELECT repo_id, path, 'testing.no_assertions' AS rule_id FROM src WHERE is_test
    UNION ALL SELECT repo_id, path, 'testing.flaky_indicators' FROM src WHERE is_test AND k % 6 = 5""",
)
def test_quality(spark, sf_dir):
    return code_rules.test_findings(facts_of(spark, sf_dir, "test", "call", tests=True)).select("repo_id", "path", "rule_id")


@query(
    "import_graph",
    f"""WITH {SOURCE_SQL}, e AS (SELECT a.repo_id, a.path AS importer, b.path FROM src a JOIN src b ON b.repo_id = a.repo_id AND b.k = a.k // 2 AND NOT b.is_test WHERE a.path <> b.path)
    SELECT repo_id, importer, path FROM e""",
)
def import_graph(spark, sf_dir):
    facts = stage(facts_of(spark, sf_dir, "import").select("repo_id", "path", F.col("resolved").alias("target")))
    from riskframe.functions.paths import module_name

    files = source_files(spark, sf_dir).select(F.col("repo_id").cast("string").alias("repo_id"), "path")
    modules = files.select("repo_id", module_name(F.col("path")).alias("module"), "path")
    internal, _external = graph.import_graph(facts, modules)
    return internal


@query(
    "library_usages",
    f"""WITH {SOURCE_SQL} SELECT repo_id AS project_id, path AS file, 'import' AS usage_kind, unnest(['jwt', 'yaml']) AS symbol FROM src
    UNION ALL SELECT repo_id, path, 'call', CASE k % 6 WHEN 3 THEN 'yaml.load' ELSE 'jwt.decode' END FROM src WHERE k % 6 IN (0, 1, 3)""",
)
def library_usages(spark, sf_dir):
    from riskframe.functions.lookup import literal_table

    libraries = literal_table(spark, [("pyjwt", "jwt"), ("pyyaml", "yaml")], "library string, root string")
    return code_rules.library_usages(facts_of(spark, sf_dir, "import", "call", "reference"), libraries).select("project_id", "file", "usage_kind", "symbol")


@query(
    "enclosing_functions",
    f"WITH {SOURCE_SQL} SELECT repo_id, path, 'test_fn' AS function, count(*) AS calls FROM src GROUP BY ALL",
)
def enclosing_functions(spark, sf_dir):
    facts = stage(facts_of(spark, sf_dir, "call", "function").select("repo_id", "path", "fact", "line", "end_line", "scope"))
    calls = facts.where("fact = 'call'").select("repo_id", "path", "line")
    placed = code_rules.enclosing_function(calls, facts)
    return placed.groupBy("repo_id", "path", "function").agg(F.count("*").alias("calls"))


@query(
    "most_complex_functions",
    f"""WITH {SOURCE_SQL}, r AS (SELECT repo_id, path, CAST(2 + 2 * (k % 6) + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS INT) AS complexity FROM src)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, path) AS position FROM r) WHERE position <= 10""",
)
def most_complex_functions(spark, sf_dir):
    return code_rules.most_complex(facts_of(spark, sf_dir, "function")).select("repo_id", "path", "complexity", "position")

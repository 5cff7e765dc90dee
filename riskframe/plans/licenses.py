"""License rules over repositories that Spark derives from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import constants as C
from riskframe.operators import license_rules
from riskframe.plans.registry import query
from riskframe.sources.adapters import table

# By customer key modulo 5: the license file's license (None: no file). By key modulo 4: what package.json states.
FILE_LICENSE = (None, "MIT", "MIT", "Apache-2.0", "GPL-3.0")
STATED = ('"MIT"', '"Apache-2.0"', '{"type": "MIT"}', '"ISC"')
# By order key modulo 6: the header of a source file. By order key modulo 10: a dependency's license, and its conflict with a permissive project.
HEADERS = ("GPL-3.0", "MIT", "MPL-2.0", "AGPL-3.0", None, "Custom")
REGISTRY = (
    ("(MIT OR GPL-3.0) AND MPL-2.0", "low"),
    ("GPL-3.0 OR MIT", None),
    ("GPL-3.0 AND MIT", "high"),
    ("GPL-3.0 OR AGPL-3.0", "high"),
    ("Unheard", None),
    ("MPL-2.0, GPL-3.0", "low"),
    ("GPL-2.0 OR (MIT AND (MPL-2.0 OR AGPL-3.0))", "low"),
    (None, None),
    ("AGPL-3.0 / Unheard", "high"),
    ("MIT", None),
)


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(key: str, values) -> str:
    shown = ["NULL" if v is None else f"'{v}'" for v in values]
    return f"([{', '.join(shown)}])[({key} % {len(values)} + 1)::INTEGER]"


SQL = f"""
WITH repos AS (
  SELECT CAST(c_custkey AS VARCHAR) AS repo_id, {_sql_pick("c_custkey", FILE_LICENSE)} AS held,
    {_sql_pick("c_custkey", ("MIT", "Apache-2.0", None, "ISC"))} AS stated FROM customer
), projects AS (SELECT *, coalesce(held, stated) AS license FROM repos
), permissive AS (SELECT * FROM projects WHERE license IN ('MIT', 'Apache-2.0', 'ISC')
), src AS (SELECT CAST(o_custkey AS VARCHAR) AS repo_id, o_orderkey AS k, {_sql_pick("o_orderkey", HEADERS)} AS header,
    {_sql_pick("o_orderkey", [s for _, s in REGISTRY])} AS severity FROM orders)
SELECT repo_id, 'license.missing' AS rule_id, 'license:project' AS subject, 'medium' AS severity, 0 AS n_files, NULL AS first_file FROM repos WHERE held IS NULL
UNION ALL SELECT repo_id, 'license.metadata_mismatch', 'license:project', 'medium', 2, 'LICENSE' FROM projects WHERE stated <> license
UNION ALL SELECT repo_id, 'license.copyleft_file', 'license-file:' || header, CASE header WHEN 'MPL-2.0' THEN 'low' ELSE 'high' END, count(*)::INTEGER, min('src/s' || k || '.py')
  FROM src JOIN permissive USING (repo_id) WHERE header IN ('GPL-3.0', 'MPL-2.0', 'AGPL-3.0') GROUP BY repo_id, header
UNION ALL SELECT DISTINCT repo_id, 'license.dependency_incompatible', 'pkg:lib' || (k % 10), severity, 1, 'package.json'
  FROM src JOIN permissive USING (repo_id) WHERE severity IS NOT NULL
"""


@query("license_findings", SQL)
def license_findings(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("repo_id"))
    texts = {spdx: " ".join(needles) for spdx, needles in C.LICENSE_FINGERPRINTS}
    repo = F.col("k").cast("string").alias("repo_id")
    licenses = customers.select(repo, F.lit("LICENSE").alias("path"), _pick(F.col("k"), [texts.get(x) for x in FILE_LICENSE]).alias("text"))
    manifests = customers.select(repo, F.lit("package.json").alias("path"), F.concat(F.lit('{"license": '), _pick(F.col("k"), STATED), F.lit("}")).alias("text"))
    header = F.concat(F.lit("#!/bin/x\n# SPDX-License-Identifier: "), _pick(F.col("o_orderkey"), HEADERS), F.lit("\nx = 1\n"))
    sources = orders.select("repo_id", F.concat(F.lit("src/s"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), header.alias("text"))
    files = licenses.where("text is not null").unionByName(manifests).unionByName(sources.where("text is not null"))
    dependencies = orders.select(
        "repo_id",
        F.concat(F.lit("lib"), (F.col("o_orderkey") % 10).cast("string")).alias("name"),
        F.lit("package.json").alias("manifest"),
        F.lit("ok").alias("registry_status"),
        _pick(F.col("o_orderkey"), [e for e, _ in REGISTRY]).alias("registry_license"),
    )
    rows = license_rules.license_findings(customers.select(repo), files, dependencies)
    return rows.select(
        "repo_id", "rule_id", "subject", "severity", F.size("affected_files").alias("n_files"), F.get("affected_files", F.lit(0)).alias("first_file")
    )

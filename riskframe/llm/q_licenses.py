"""op9: license declarations of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.licenses import scan_licenses
from riskframe.llm.registry import query


@query("op9_license_rules")
def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")

"""op8: base rules and the learned verdict for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.quality import fit, quality_verdicts
from riskframe.llm.registry import query


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_verdicts(docs, fit(docs, read_table(spark, sf_dir, "labels")))

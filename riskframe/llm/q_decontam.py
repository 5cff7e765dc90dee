"""op5: documents that hold benchmark items, also with other numbers, names and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.decontam import contaminated_pairs
from riskframe.llm.registry import query


@query("op5_template_decontamination")
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("_th")

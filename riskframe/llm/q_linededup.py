"""op1: lines and sentences that repeat across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.linededup import PASSAGE_WORDS, repeated_units
from riskframe.llm.registry import query


@query("op1_repeated_lines")
def op1_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(read_table(spark, sf_dir, "documents"), PASSAGE_WORDS, runs=True, across_lines=True).drop("_th")

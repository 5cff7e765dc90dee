"""op3: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.langid import identify_languages
from riskframe.llm.registry import query


@query("op3_kneser_ney_language")
def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents")).drop("_th")

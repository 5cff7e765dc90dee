"""op11: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import read_table
from riskframe.llm.registry import query
from riskframe.llm.toxicity import fit, toxicity_scores


@query("op11_weighted_lexicon")
def op11_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")))

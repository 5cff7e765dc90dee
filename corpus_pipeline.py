"""The corpus pipeline: five stages over ``documents``, each written as a table before the next one reads it.

1. language: documents whose language is rejected go
2. near duplicates: of each group of near-duplicate documents one stays
3. repeated lines: repeated lines and sentences are cut from the texts
4. benchmark: documents that hold benchmark items go
5. pieces: the documents that are left, as sampled segmentations

All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import read_table, written
from riskframe.llm.decontam import without_contaminated
from riskframe.llm.keepone import one_of_each_group
from riskframe.llm.langid import without_rejected
from riskframe.llm.linededup import PASSAGE_WORDS, without_repeats
from riskframe.llm.pieces import encode_samples
from riskframe.llm.q_pieces import MODEL

#: No SQL gives these rows: models and samples decide. The stages are tested against brute-force versions.
ORACLE_SQL = None

#: Rows of an Arrow batch between executor and Python worker. Documents are long: a batch of this many is a few megabytes,
#: where the default of ten times as many is held several times over by either side.
ARROW_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose language is rejected: null and wordless texts go. Repeated rows stay, an empty table stays empty."""
    _short_batches(spark)
    return without_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words are no group and stay."""
    _short_batches(spark)
    return one_of_each_group(docs, width=5, percent=80)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeats; ``n_chars`` follows the text."""
    _short_batches(spark)
    cut = without_repeats(docs, PASSAGE_WORDS, runs=True, across_lines=True)
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("n_chars", counted)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    _short_batches(spark)
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and sample: doc_id, sample, ids, n_pieces, log_prob, log_inclusion, round_trip."""
    _short_batches(spark)
    return encode_samples(docs, MODEL, samples=2).drop("_th", "perturbed")


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("repeated lines", repeated_lines),
    ("benchmark", benchmark),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

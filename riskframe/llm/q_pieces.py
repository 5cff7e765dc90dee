"""op2: sampled segmentations of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import read_table
from riskframe.llm.pieces import encode_samples
from riskframe.llm.registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_gumbel_pieces")
def op2_gumbel_pieces(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    rows = encode_samples(read_table(spark, sf_dir, "documents"), model_path, samples=2)
    return rows.select("doc_id", "sample", "n_pieces", F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "round_trip")

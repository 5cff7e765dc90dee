"""Session defaults and lineage cutting.

Iterative operators cut their lineage with reliable checkpoints, so that a lost executor costs one
re-read and not a replay of every round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session we build ourselves; a cluster's own settings win where they are given.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "false",
}


def build_session(app: str = "riskframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's ``spark.checkpoint.dir``; local mode may use a temp folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative operators write checkpoints there")
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return it without its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    For results that several later steps read: each of them prunes columns on the table instead of computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

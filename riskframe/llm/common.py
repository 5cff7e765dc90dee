"""What the operators share: reading tables, row identity, guarded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import stage

BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column | str) -> Column:
    """64 bits of a text. With the row's id it names a row: rows equal in both are one document."""
    return F.xxhash64(text)


def small_side(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The (written) table of narrow rows, marked for broadcast if it is counted to have ``limit`` rows at most."""
    return F.broadcast(table) if table.count() <= limit else table


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that a lost executor costs no replay and no row is computed twice."""
    return stage(df)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_by_key(docs: DataFrame, keys: DataFrame, how: str, id_column: str, text_column: str) -> DataFrame:
    """Semi- or anti-join of documents, all columns kept, with ``keys(doc_id, _th)``: ids and hashes of texts, null equal to null."""
    id_name, hash_name = unused(docs, "_key_id"), unused(docs, "_key_th")
    side = written(keys.select(F.col("doc_id").alias(id_name), F.col("_th").alias(hash_name)).distinct())
    same = F.col(id_column).cast("long").eqNullSafe(F.col(id_name)) & (text_hash(text_column) == F.col(hash_name))
    return docs.join(small_side(side), same, how)

"""Ranks within groups of any size.

A window over a whole group would sort it in one task. Here all rows are range-partitioned by (group, order), each range is
numbered on its own, and the counts of the ranges before it (one small row per group and range) shift its numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import written

ROWS_PER_RANGE = 1 << 16


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of a written table with ``rank`` (from 0, by ``order``, nulls first) and ``n`` (rows) within their ``key``;
    null is a group of its own. Rows equal in key and order should differ in a last order column where they may be many:
    they share a range otherwise."""
    ranges = rows.count() // ROWS_PER_RANGE + 1
    dealt = written(rows.repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy("_key")
    shifts = (
        dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("n", F.sum("_rows").over(whole))
    )
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    return (
        dealt.withColumn("_own", own)
        .join(shifts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
        .withColumn("rank", F.col("_own") + F.coalesce("_before", F.lit(0)))
        .select(*rows.columns, "rank", "n")
    )

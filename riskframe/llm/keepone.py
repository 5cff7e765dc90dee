"""One document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import rows_by_key, text_hash, written
from riskframe.llm.neardup import SIMILARITY_PERCENT, near_duplicates


def one_of_each_group(
    docs: DataFrame, width: int = 5, percent: int = SIMILARITY_PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents, all columns kept, one of each group of near duplicates: that of the smallest id, then of the smallest
    text hash. Documents without words are no group and all stay. Of rows equal in id and text one stays."""
    found = written(near_duplicates(docs, width, percent, id_column, text_column))
    left = rows_by_key(docs, found.where(~F.col("keeper")), "left_anti", id_column, text_column)
    twice = written(found.where("keeper").groupBy("doc_id", "_th").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    if twice.isEmpty():
        return left
    again = rows_by_key(left, twice, "left_semi", id_column, text_column)
    first = again.groupBy(F.col(id_column).alias("_id"), text_hash(text_column).alias("_hash")).agg(
        F.first(F.struct(*[again[c] for c in again.columns])).alias("_row")
    )
    return rows_by_key(left, twice, "left_anti", id_column, text_column).unionByName(first.select("_row.*"))

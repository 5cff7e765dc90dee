"""Small fixed tables as column expressions. A dozen branches cost less than a join and stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import constants as C


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """The table's value for ``key``; ``default`` where the key is not listed."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_RANK, 0)


def advisory_rank(severity: Column) -> Column:
    return lookup(severity, C.ADVISORY_RANK, 0)


def stable_round(value: Column, digits: int) -> Column:
    """Round with a nudge far below the last digit, so that sums taken in another order round alike."""
    return F.round(value + F.lit(1e-10), digits)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table of a few rows, small by construction and therefore safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))

"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key's shard follows from the key and the number of shards alone, without a ring table; with one more shard only the
share 1 / (shards + 1) of the keys moves, all into the new shard. The generator is the published one: a 64-bit linear
congruential step per jump, whose high bits say how far to jump.

Spark's integers raise an error on overflow, so the 64-bit product is taken on limbs of 22, 22 and 20 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written

LAW = "key"
ROWS_PER_BUCKET = 4096

# Multiplier and increment of the published generator.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LOW = (1 << 22) - 1
_TOP = (1 << 20) - 1
_M = (MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, MULTIPLIER >> 44)


def _step(k0: Column, k1: Column, k2: Column) -> tuple[Column, Column, Column]:
    """key * MULTIPLIER + INCREMENT modulo 2**64, on limbs."""
    p0 = k0 * _M[0] + INCREMENT
    p1 = k0 * _M[1] + k1 * _M[0] + F.shiftright(p0, 22)
    p2 = k0 * _M[2] + k1 * _M[1] + k2 * _M[0] + F.shiftright(p1, 22)
    return p0.bitwiseAND(F.lit(_LOW)), p1.bitwiseAND(F.lit(_LOW)), p2.bitwiseAND(F.lit(_TOP))


def jump_path(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard of ``shards`` and of ``shards + 1``.

    A null key takes the path of key 0. The walk needs about ln(shards) jumps; the loop has ``shards + 1`` turns, as many
    as there can be, and turns after the last jump do nothing.
    """
    word = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        word.bitwiseAND(F.lit(_LOW).cast("long")).alias("k0"),
        F.shiftrightunsigned(word, 22).bitwiseAND(F.lit(_LOW).cast("long")).alias("k1"),
        F.shiftrightunsigned(word, 44).alias("k2"),
        F.lit(0).cast("long").alias("next"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def turn(s: Column, _: Column) -> Column:
        k0, k1, k2 = _step(s["k0"], s["k1"], s["k2"])
        high = (F.shiftleft(k2, 11) + F.shiftright(k1, 11) + 1).cast("double")
        jumped = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / high)).cast("long")
        moved = F.struct(
            k0.alias("k0"),
            k1.alias("k1"),
            k2.alias("k2"),
            jumped.alias("next"),
            F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"),
            s["next"].alias("grown"),
        )
        return F.when(s["next"] <= shards, moved).otherwise(s)

    turns = F.sequence(F.lit(0), F.lit(shards + 1))
    return F.aggregate(turns, start, turn, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def assign_shards(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps, in the order of the id's CRC-32, the id, the text's CRC-32 and
    the size. A shard is cut into as many buckets by the first of these as keep about ``ROWS_PER_BUCKET`` rows in each;
    buckets are numbered on their own and shifted by the rows before them, so no task sees a whole shard.

    Nulls: a text of null has no bytes (size 16, CRC-32 0); a null id takes the shard of key 0 and comes first in order.
    Rows equal in all columns get slots of their own. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    id_ = F.col(id_column)
    path = jump_path(id_, shards)
    rows = written(
        docs.select(
            id_.alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.crc32(id_.cast("string").cast("binary")), F.lit(-1)).cast("long").alias("_order"),
            path.alias("_path"),
        ).select("doc_id", "size", "text_crc32", "_order", F.col("_path.shard").alias("shard"), F.col("_path.grown").alias("grown_shard"))
    )
    per_shard = max(1, rows.count() // (shards * ROWS_PER_BUCKET))
    bucket = F.floor(F.greatest(F.col("_order"), F.lit(0)) * per_shard / F.lit(float(1 << 32))).cast("int")
    dealt = rows.withColumn("_bucket", bucket)
    counts = dealt.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.selectExpr(
        "shard as _shard",
        "_bucket as _b",
        "coalesce(sum(_rows) over (partition by shard order by _bucket rows between unbounded preceding and 1 preceding), 0) as _before",
    )
    numbered = dealt.selectExpr(
        "*", "row_number() over (partition by shard, _bucket order by _order, doc_id, text_crc32, size) - 1 as _place"
    )
    return numbered.join(before, (F.col("shard") == F.col("_shard")) & (F.col("_bucket") == F.col("_b"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("_place") + F.col("_before")).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_column: str = "doc_id") -> None:
    """The documents as Parquet under ``path``, one folder per shard. Each task writes what it has read: no shuffle, and a
    shard of any size is many files."""
    docs.withColumn("shard", jump_path(F.col(id_column), shards)["shard"]).write.partitionBy("shard").parquet(path)

"""Chat formatting after the collapse of cumulative snapshots.

A log that writes a conversation again after every turn holds it many times, each time as a prefix of the next. A turn's term
is a hash of its place and content, and the sum of a conversation's first k terms, taken twice with different hashes, is the
rolling hash of its prefix of k turns. A conversation is dropped if its whole hash is the hash of a proper prefix of another
one (an anti-join with the distinct prefixes), and of equal conversations the smallest id stays.

Turns are numbered and summed in buckets of ``BUCKET`` turn numbers; each bucket is shifted by what the buckets before it
hold, so a conversation of any length is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import small_side, written

BUCKET = 256
START, END = "<|im_start|>", "<|im_end|>"
_KEYS = ["conv_id", "turn", "role", "_h1", "_h2"]
_NO_TURN = -(1 << 62)


def _content(salt: int) -> Column:
    """A hash of a turn's text in which null differs from the empty text."""
    return F.xxhash64(F.lit(salt), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _term(hash_name: str) -> Column:
    return F.xxhash64("place", F.col("role").isNull(), F.coalesce("role", F.lit("")), hash_name).cast("decimal(38,0)")


def _shifted(rows: DataFrame, totals: DataFrame, names: list[str]) -> DataFrame:
    """Adds to each named column what the conversation's earlier buckets hold of it, by ``totals(conv_id, _bucket, names…)``."""
    before = Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("conv_id").alias("_conv"), F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names]
    )
    joined = rows.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in names}).drop("_conv", "_b", *[f"_before_{n}" for n in names])


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """One row per distinct turn: conv_id, turn, role, _h1, _h2, place (from 1), s1, s2 (the prefix's rolling hash), n_turns."""
    turns = written(
        conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", _content(1).alias("_h1"), _content(2).alias("_h2"))
        .distinct()
        .withColumn("_bucket", F.coalesce(F.floor(F.col("turn") / BUCKET).cast("long"), F.lit(_NO_TURN)))
    )
    order = Window.partitionBy("conv_id", "_bucket").orderBy("turn", "role", "_h1", "_h2")
    counts = turns.groupBy("conv_id", "_bucket").agg(F.count(F.lit(1)).alias("place"))
    placed = _shifted(turns.withColumn("place", F.row_number().over(order).cast("long")), counts, ["place"])
    terms = written(placed.withColumns({"s1": _term("_h1"), "s2": _term("_h2")}))
    sums = terms.groupBy("conv_id", "_bucket").agg(F.sum("s1").cast("decimal(38,0)").alias("s1"), F.sum("s2").cast("decimal(38,0)").alias("s2"))
    rolling = Window.partitionBy("conv_id", "_bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inner = terms.withColumns({n: F.sum(n).over(rolling).cast("decimal(38,0)") for n in ("s1", "s2")})
    totals = terms.groupBy(F.col("conv_id").alias("_id")).agg(F.count(F.lit(1)).alias("n_turns"))
    return (
        _shifted(inner, sums, ["s1", "s2"])
        .join(totals, F.col("conv_id").eqNullSafe(F.col("_id")))
        .select(*_KEYS, "place", F.col("s1").cast("decimal(38,0)").alias("s1"), F.col("s2").cast("decimal(38,0)").alias("s2"), "n_turns")
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """The ids (``conv_id``, ``n_turns``) of conversations that are no proper prefix of another, one of equal ones."""
    hashes = ["place", "s1", "s2"]
    whole = prefixes.where(F.col("place") == F.col("n_turns")).groupBy(*hashes).agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where(F.col("place") < F.col("n_turns")).select(*hashes).distinct()
    return whole.join(proper, hashes, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    """A turn between its marks; marks within role or text are broken up, so that no text can end its turn."""

    def plain(value: Column) -> Column:
        return F.replace(F.coalesce(value, F.lit("")), F.lit("<|im_"), F.lit("<\\|im_"))

    return F.concat(F.lit(START), plain(role), F.lit("\n"), plain(text), F.lit(f"{END}\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """The turns of the maximal conversations, rendered: conv_id, place (from 1), n_turns, role, rendered.

    A conversation's text is its rows in order of ``place``; it is not gathered into one row. Turns are ordered by number, then
    role, then content; null comes first. Rows equal in all four columns are one turn. Rows without a conversation id form a
    conversation without an id, which stays only if no equal one has an id. Null roles and texts are rendered as empty
    but differ from empty ones. Other columns are not read. An empty table gives no rows.
    """
    prefixes = written(turn_prefixes(conversations))
    kept = written(maximal_conversations(prefixes).withColumnRenamed("conv_id", "_kept").select("_kept"))
    places = prefixes.join(small_side(kept), F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi")
    names = {k: f"_p{i}" for i, k in enumerate(_KEYS)}
    right = places.select(*[F.col(k).alias(n) for k, n in names.items()], "place", "n_turns")
    left = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", _content(1).alias("_h1"), _content(2).alias("_h2"))
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return (
        left.join(right, same)
        .dropDuplicates(["conv_id", "place"])
        .select("conv_id", "place", "n_turns", "role", rendered(F.col("role"), F.col("text")).alias("rendered"))
    )

"""Order-dependent operators that must not sort a whole case in one task.

A case may hold a large share of all rows. Rows are therefore cut into time buckets: each bucket is sorted on its own,
and what the earlier buckets add is carried over from one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(when: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(when) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_sequence(
    df: DataFrame, keys: list[str], when: str, tie: str, out: str = "seq", bucket_seconds: int = 3600, start: DataFrame | None = None
) -> DataFrame:
    """Number rows 1, 2, … per key in the order of ``(when, tie)``.

    ``start(keys…, high_water)`` continues the numbering of rows written before.
    """
    bucketed = df.withColumn("_bucket", time_bucket(F.col(when), bucket_seconds))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if start is not None:
        offsets = offsets.join(start, keys, "left").withColumn(
            "_offset", F.col("_offset") + F.coalesce("high_water", F.lit(0))
        ).drop("high_water")
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(when, tie))
    return (
        bucketed.withColumn("_local", local)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_bucket")
    )


def peak_parallelism(
    runs: DataFrame, keys: list[str], start: str = "started_at", end: str = "completed_at", bucket_seconds: int = 3600
) -> DataFrame:
    """The largest number of runs open at once. At one instant, ends come before starts."""
    points = runs.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))
            )
        ).alias("p"),
    )
    net = (
        points.groupBy(*keys, "p.t")
        .agg(F.sum("p.d").alias("_net"))
        .withColumn("_bucket", time_bucket(F.col("t"), bucket_seconds))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        net.withColumn("_running", F.sum("_net").over(inside))
        .groupBy(*keys, "_bucket")
        .agg(F.max("_running").alias("_peak"), F.sum("_net").alias("_total"))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("_total").over(before), F.lit(0)) + F.col("_peak")
    return (
        buckets.withColumn("_at_peak", carried)
        .groupBy(*keys)
        .agg(F.greatest(F.lit(0), F.max("_at_peak")).cast("bigint").alias("parallelism"))
    )


def run_offsets(runs: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Where each run sits on its case's time axis: left edge and width in percent, at least one second overall."""
    start, end = F.unix_micros("started_at"), F.unix_micros(F.coalesce("completed_at", now))
    shown = runs.where((F.col("agent") != "orchestrator") & F.col("started_at").isNotNull())
    spans = (
        shown.groupBy(*keys)
        .agg(F.min(start).alias("_t0"), F.max(end).alias("_t1"))
        .withColumn("_span", F.greatest(F.col("_t1"), F.col("_t0") + 1_000_000) - F.col("_t0"))
    )
    return (
        shown.join(spans.drop("_t1"), keys)
        .withColumn("left_percent", (start - F.col("_t0")) / F.col("_span") * 100)
        .withColumn("width_percent", F.greatest(F.lit(0.5), (end - start) / F.col("_span") * 100))
        .drop("_t0", "_span")
    )


def rate_limit_decisions(
    hits: DataFrame, client: str, when: str, tie: str, per_minute: int, window_seconds: int = 60
) -> DataFrame:
    """Replay a sliding limit that records only accepted hits; adds ``accepted`` and ``wait_seconds``.

    A pause longer than the window forgets everything, so a client's hits fall into sessions that can be replayed apart.
    Pauses are found on one row per client and window-sized bucket. A session is streamed in order, with a state of at
    most ``per_minute`` instants.
    """
    bucketed = hits.withColumn("_bucket", time_bucket(F.col(when), window_seconds))
    spans = bucketed.groupBy(client, "_bucket").agg(F.min(when).alias("_first"), F.max(when).alias("_last"))
    by_client = Window.partitionBy(client).orderBy("_bucket")
    pause = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(by_client)) > window_seconds * 1_000_000
    sessions = spans.withColumn("_new", F.coalesce(pause, F.lit(True)).cast("int")).select(
        client, "_bucket", F.sum("_new").over(by_client).alias("_session")
    )
    ordered = (
        bucketed.join(sessions, [client, "_bucket"])
        .drop("_bucket")
        .repartition(client, "_session")
        .sortWithinPartitions(client, "_session", when, tie)
    )

    def replay(batches):
        from collections import deque

        current, accepted_at = None, deque()
        for batch in batches:
            flags, waits = [], []
            for key, session, at in zip(batch[client], batch["_session"], batch[when], strict=True):
                if (key, session) != current:
                    current, accepted_at = (key, session), deque()
                now = at.value / 1e9
                while accepted_at and now - accepted_at[0] > window_seconds:
                    accepted_at.popleft()
                if len(accepted_at) >= per_minute:
                    flags.append(False)
                    waits.append(max(0.0, window_seconds - (now - accepted_at[0])))
                else:
                    accepted_at.append(now)
                    flags.append(True)
                    waits.append(None)
            batch["accepted"], batch["wait_seconds"] = flags, waits
            yield batch.drop(columns="_session")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields if f.name != "_session")
    return ordered.mapInPandas(replay, f"{fields}, accepted boolean, wait_seconds double")

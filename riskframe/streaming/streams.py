"""Event, notification and activity views kept current with Structured Streaming.

Streams write tables, never to the driver. Checkpoints live in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from riskframe.functions.text import redact
from riskframe.operators.activity import failed_run
from riskframe.operators.notify import matched_channels
from riskframe.operators.store import append_events, due_watches
from riskframe.session import checkpoint_root


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 200) -> DataFrame:
    """The events table as a stream: each run continues where the last one stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def redacted(events: DataFrame, columns: tuple[str, ...] = ("message",)) -> DataFrame:
    """Redaction on the write path: what leaves the stream carries no credential."""
    return events.withColumns({c: redact(F.col(c)) for c in columns})


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that is there and stop; started again, it goes on with what is new."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.outputMode(mode).trigger(availableNow=True).start()


def append_numbered(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events with sequence numbers that continue each case's numbering in the table at ``path``.

    Beside each batch stands its high-water table, one row per case seen so far: the next batch reads that and no event
    written before. A batch that is written again after a failure starts from the same high water and replaces its own
    folders, so numbers stay dense. Folders of high water older than the last batch can be removed at any time.
    """

    def high_water(batch_id: int) -> str:
        return f"{path}/_high_water/batch={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        case = batch.schema["repo_id"].dataType.simpleString()
        schema = f"repo_id {case}, high_water long"
        before = spark.read.schema(schema).parquet(high_water(batch_id - 1)) if batch_id > 0 else spark.createDataFrame([], schema)
        numbered = append_events(batch, before)
        folder = f"{path}/batch={batch_id}"
        numbered.write.mode("overwrite").parquet(folder)
        reached = spark.read.schema(numbered.schema).parquet(folder).select("repo_id", F.col("seq").alias("high_water"))
        after = before.unionByName(reached).groupBy("repo_id").agg(F.max("high_water").alias("high_water"))
        after.write.mode("overwrite").parquet(high_water(batch_id))

    return each_batch(stream, write, checkpoint)


def case_counters(runs: DataFrame) -> DataFrame:
    """Running counters per case, in update or complete mode."""
    return runs.groupBy("repo_id").agg(
        F.count("*").alias("agent_runs"),
        F.count_if(failed_run()).alias("agent_failures"),
        F.count_if(F.col("trigger") == "retry").alias("retries"),
        F.count_if(F.col("trigger").isin("follow_up", "verification_request")).alias("follow_ups"),
    )


def dispatch_stream(events: DataFrame, rules: DataFrame, channels: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Deliveries of a stream of events: joined to rules and channels, one per event and channel."""
    matched = matched_channels(events.withWatermark("ts", delay), rules, channels)
    return matched.dropDuplicatesWithinWatermark(["event_id", "channel_id"]).select(
        "event_id", "ts", "event", "channel_id", "rule_id", "status", "error"
    )


def due_watch_batches(watches: Callable[[], DataFrame], act: Callable[[DataFrame], None], limit: int | None = None):
    """A ``foreachBatch`` body for a stream of ticks: at each tick, the watches due at its latest instant are acted on."""

    def on_tick(ticks: DataFrame, _batch_id: int) -> None:
        now = ticks.agg(F.max("timestamp")).first()[0]
        if now is not None:
            act(due_watches(watches(), F.lit(now), limit))

    return on_tick


def due_by_timer(checks: DataFrame, watch: str, when: str, hours: str, delay: str = "0 seconds") -> DataFrame:
    """Watches that fall due, from a stream of their checks: ``watch``, ``due_at``.

    A check sets its watch's timer ``hours`` ahead (null: never due); a later check sets it anew, of checks at one instant
    the shortest counts. The timer fires once event time, less ``delay``, has passed it; the state then goes, until the
    watch is checked again. State is two numbers a watch, and a batch of any size is read piece by piece. Rows without
    an instant or a watch are left out.
    """
    narrow = checks.where(F.col(when).isNotNull() & F.col(watch).isNotNull()).withWatermark(when, delay)
    narrow = narrow.select(watch, when, F.unix_millis(when).alias("_at"), F.col(hours).cast("double").alias("_hours"))
    kind = narrow.schema[watch].dataType.simpleString()

    def pick(key: tuple, chunks: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        def fired(due: int) -> pd.DataFrame:
            return pd.DataFrame({watch: [key[0]], "_due": [due]})

        if state.hasTimedOut:
            due = state.get[1]
            state.remove()
            yield fired(due)
            return
        last, due = state.get if state.exists else (None, None)
        for chunk in chunks:
            at = int(chunk["_at"].max())
            if last is not None and at < last:
                continue
            wait = chunk.loc[chunk["_at"] == at, "_hours"].min()
            ahead = None if pd.isna(wait) else at + int(wait * 3_600_000)
            tied = [d for d in (due if at == last else None, ahead) if d is not None]
            last, due = at, min(tied, default=None)
        passed = state.getCurrentWatermarkMs()
        if due is not None and due < passed:
            if state.exists:
                state.remove()
            yield fired(due)
            return
        state.update((last, due))
        if due is not None:
            state.setTimeoutTimestamp(max(due, passed + 1))

    timed = narrow.groupBy(watch).applyInPandasWithState(
        pick, f"`{watch}` {kind}, _due long", "last long, due long", "append", "EventTimeTimeout"
    )
    return timed.select(watch, F.timestamp_millis("_due").alias("due_at"))


def rate_limited(hits: DataFrame, client: str, when: str, tie: str, per_minute: int, window_seconds: int = 60) -> DataFrame:
    """A sliding limit per client over a stream that records accepted hits only.

    The state is the accepted instants of the window, at most ``per_minute`` numbers. Hits of one micro-batch are put in
    order per client; ``maxFilesPerTrigger`` bounds them.
    """
    fields = hits.select(client, when, tie).schema
    kinds = {f.name: f.dataType.simpleString() for f in fields}

    def decide(key: tuple, chunks: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        accepted = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(chunks)).sort_values([when, tie])
        flags, waits = [], []
        for at in batch[when]:
            now = at.value / 1e9
            accepted = [t for t in accepted if now - t <= window_seconds]
            full = len(accepted) >= per_minute
            flags.append(not full)
            waits.append(max(0.0, window_seconds - (now - accepted[0])) if full else None)
            if not full:
                accepted.append(now)
        state.update((accepted,))
        yield pd.DataFrame(
            {client: key[0], tie: batch[tie].to_numpy(), when: batch[when].to_numpy(), "accepted": flags, "wait_seconds": pd.Series(waits, dtype="float64").to_numpy()}
        )

    return hits.select(client, tie, when).groupBy(client).applyInPandasWithState(
        decide,
        f"{client} {kinds[client]}, {tie} {kinds[tie]}, {when} {kinds[when]}, accepted boolean, wait_seconds double",
        "accepted array<double>",
        "append",
        "NoTimeout",
    )

"""Streams of requests, logins and outcomes: rates, counters, health, lockout, expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.rulepack import RulePack
from veilspark.operators.mask import mask
from veilspark.sources.tables import shared_folder


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream over a parquet folder or a single file.

    A stream refuses the plain name of a file but takes a pattern; the last
    letter as a one-letter pattern matches just this name.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(
    stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Process everything available, write it to a folder and read that back.

    Each micro-batch goes to its own folder by number, so a repeated batch
    replaces its earlier output.  A transform may read its batch more than once, so
    the batch is kept until then and the state behind it is only asked once.
    """
    root = shared_folder(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        rows = transform(batch.persist()) if transform else batch
        try:
            rows.write.mode("overwrite").parquet(f"{root}/out/batch_no={number}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def mask_stream(messages: DataFrame, text: str, pack: RulePack = RulePack(),
                message_no: str | None = None) -> DataFrame:
    """Masking needs no state: numbers come from the message's place in its session."""
    return mask(messages, text, pack, message_no=message_no)


def rate_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Requests per client and minute; emit with mode ``update``."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 minute").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("minute"), "n")
    )


def live_counts(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour",
                slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per type and time window; emit with mode ``update``."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        events.withWatermark(ts, late)
        .groupBy(window.alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(by, F.col("w.start").alias("start"), "n")
    )


def latest_update(updates: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Last value per key of an update stream."""
    return updates.groupBy(*keys).agg(F.max_by(value, "batch_no").alias(value))


_STREAK_STATE = "streak long"


def _streaks(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    (streak,) = state.get if state.exists else (0,)
    for rows in _by_id(frames):
        # failures since the latest success, or carried from before when there is none
        fails = rows["failed"].astype("int64").cumsum()
        at_success = fails.where(~rows["failed"]).ffill()
        run = (fails - at_success.fillna(0)).astype("int64")
        run = run.where(at_success.notna(), run + streak)
        streak = int(run.iloc[-1])
        yield pd.DataFrame({"node": key[0], "id": rows["id"], "ts": rows["ts"], "streak": run})
    if streak:
        state.update((streak,))
    elif state.exists:
        state.remove()


def _by_id(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("id").reset_index(drop=True)
    if len(rows):
        yield rows


def streaks(outcomes: DataFrame) -> DataFrame:
    """Failures in a row per node with the time of each outcome; only nodes that fail now have state, one number."""
    return outcomes.groupBy("node").applyInPandasWithState(
        _streaks, "node string, id long, ts timestamp, streak long", _STREAK_STATE, "append", "NoTimeout"
    )


def health(with_streak: DataFrame) -> DataFrame:
    return with_streak.withColumn("healthy", F.col("streak") < C.FAILURES_TO_UNHEALTHY)


def lockout(with_streak: DataFrame, ts: str = "ts") -> DataFrame:
    """Attempts left, and until when a client is locked after a failure too many."""
    return with_streak.withColumns(
        {
            "remaining": F.greatest(F.lit(0), C.FAILURES_TO_LOCK - F.col("streak")),
            "locked_until": F.when(
                F.col("streak") >= C.FAILURES_TO_LOCK,
                F.col(ts) + F.expr(f"interval {C.LOCK_MINUTES} minutes"),
            ),
        }
    )


def _expire(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame({"session_id": [key[0]], "last_seen_ms": [last]})
        return
    rows = pd.concat(list(frames))
    ttl = int(rows["ttl_ms"].iloc[0])
    seen = rows["seen_ms"].sort_values()
    if state.exists:
        seen = pd.concat([pd.Series(state.get), seen]).sort_values()
    # a gap above the time to live ends the session, also inside a batch
    ended = seen[(seen.shift(-1) - seen) > ttl]
    last = int(seen.iloc[-1])
    state.update((last,))
    state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"session_id": key[0], "last_seen_ms": ended.astype("int64")})


def expired_sessions(mappings: DataFrame, ttl_seconds: int, ts: str = "ts",
                     late: str = "1 minute") -> DataFrame:
    """Each time a session goes without a mapping for longer than the time to live: its last mapping before.

    Gaps count whether or not a micro-batch ends in them, so the result does not
    depend on how the stream is cut.
    """
    return (
        mappings.withWatermark(ts, late)
        .select("session_id", ts, F.unix_millis(ts).alias("seen_ms"),
                F.lit(ttl_seconds * 1000).cast("long").alias("ttl_ms"))
        .groupBy("session_id")
        .applyInPandasWithState(
            _expire, "session_id string, last_seen_ms long", "last long", "append",
            "EventTimeTimeout",
        )
    )


def fan_out(stream: DataFrame, sinks: dict[str, str], checkpoint: str):
    """Write each micro-batch of an event feed to several folders; returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for name, path in sinks.items():
            kept.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )

"""Structured Streaming operators.

Sinks are append-only logs in the shared folder named by
``spark.checkpoint.dir``; the cookie jar is a newest-per-key aggregate over its
log, so no sink rewrites a snapshot per batch and nothing passes through the
driver. States (W1, W2, W3) are bounded by the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.operators import cookies as K
from pagefold.operators import events as E
from pagefold.session import checkpoint_dir

def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stream_network_entries(events: DataFrame, idle: str, watermark: str, redact: bool = True) -> DataFrame:
    """Incremental E1 (append mode). A request's slot is the fold of its
    events up to a silence of ``idle``; when the watermark passes that silence its
    timer fires: the slot is emitted once, finished or still pending, and leaves the
    state. Late and out-of-order events within ``watermark`` change exactly what
    they would have changed in time; later ones are dropped and counted by the
    progress. Headers are redacted before they enter the state.

    Columns: E1's, and ``slot`` (start: first event, end: when the timer fired).
    Over closed slots the result equals E1 of each island of a request's events.
    """
    slots = E.slot_states(E.conform_events(events).withWatermark("event_time", watermark),
                          [*E.KEY, F.session_window("event_time", idle).alias("slot")], redact)
    return E.slot_entries(slots, [*E.KEY, "slot"], redact)


def stream_pending_counts(entries: DataFrame, window: str) -> DataFrame:
    """Requests still in flight when their timer fired, per resource type and
    tumbling window: a second stateful operator on W1's output (append mode)."""
    return (entries.where("state IN ('pending', 'responded')")
            .groupBy(F.window(F.window_time("slot"), window).alias("w"), "resource_type").agg(F.count("*").alias("n_pending")))


def stream_quiet_sessions(events: DataFrame, idle: str, watermark: str) -> DataFrame:
    """Activity islands per session split by ``idle`` (session windows)."""
    return (events.withWatermark("event_time", watermark)
                  .groupBy("session_id", F.session_window("event_time", idle).alias("w"))
                  .agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")))


def stream_cookie_jar(observations: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Each batch is reduced to its newest row per identity (K2) and
    appended to an observation log; ``cookie_jar_from_log`` applies K2 over
    the log, so the jar equals K2 over every observation seen."""
    def write(batch: DataFrame, _epoch: int) -> None:
        K.cookie_jar(batch).write.mode("append").parquet(sink)

    w = observations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def cookie_jar_from_log(spark: SparkSession, sink: str) -> DataFrame:
    return K.cookie_jar(spark.read.parquet(sink))


def stream_console_errors(console_events: DataFrame) -> DataFrame:
    """Console errors and exceptions (stateless)."""
    return E.console_events(console_events).where("level IN ('error', 'exception')")

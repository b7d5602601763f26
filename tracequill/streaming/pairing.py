"""Pairing of a stream of events into operations, in order of arrival within a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import operation_key
from ..schema import EVENT_TYPES, SPAN_TYPES

OPERATION = "op_key string, channel string, start_ms double, end_ms double, duration_ms double, status string"
STATE = "channel string, start_ms double"
_NAMES = [f.split()[0] for f in OPERATION.split(", ")]


def valid(events: DataFrame) -> DataFrame:
    """Events of a known type with a channel and a time that is a number."""
    return events.filter(F.col("event_type").isin(*EVENT_TYPES) & (F.col("channel") != "") & F.col("ts_ms").isNotNull() & ~F.isnan("ts_ms"))


def _step(wait_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            channel, start = state.get
            state.remove()
            yield pd.DataFrame([(key[0], channel, start, None, 0.0, "incomplete")], columns=_NAMES)
            return
        pending = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "seq"], kind="stable")
        out = []
        for channel, kind, ts in zip(rows["channel"], rows["event_type"], rows["ts_ms"], strict=True):
            if kind == "start":
                pending = (channel, float(ts))
                continue
            begun, failed = pending is not None, kind == "error"
            start = pending[1] if begun else float(ts)
            out.append((key[0], channel, start, None if failed else float(ts), float(ts) - start, "error" if failed else "success" if begun else "incomplete"))
            pending = None
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update(pending)
            state.setTimeoutTimestamp(max(int(pending[1]) + wait_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def pair_stream(events: DataFrame, late: str = "10 minutes", wait_ms: int = 3_600_000) -> DataFrame:
    """A stream of events -> a stream of operations, each as soon as it ends.

    Out of a batch, a key's events go by time and arrival; over batches, by arrival. Events later than
    `late` behind the latest are dropped by the watermark. A start without an end comes out incomplete
    when the watermark is wait_ms past it. Later starts take the place of earlier ones of their key.
    """
    rows = valid(events).filter(F.col("event_type").isin(*SPAN_TYPES)).withColumn("op_key", operation_key())
    rows = rows.withColumn("event_time", F.timestamp_millis(F.col("ts_ms").cast("long"))).withWatermark("event_time", late)
    rows = rows.select("op_key", "seq", "channel", "event_type", "ts_ms", "event_time")
    return rows.groupBy("op_key").applyInPandasWithState(_step(wait_ms), OPERATION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def channel_totals(operations: DataFrame) -> DataFrame:
    """Running statistics of each channel of a stream of operations, percentiles approximate; use output mode complete or update."""
    d = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return operations.groupBy("channel").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(F.col("status") == "incomplete").alias("incomplete"),
        F.coalesce(F.avg(d), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.percentile_approx(d, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10_000), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("p50_p95_p99_ms"),
    )


def flame_windows(samples: DataFrame, window_ms: int = 3000, late: str = "10 seconds") -> DataFrame:
    """A stream of samples (ts_ms, node_id, delta_us) -> hits and time of each node per window of 0.5 to 60 seconds."""
    size = f"{min(60_000, max(500, window_ms))} milliseconds"
    rows = samples.withColumn("event_time", F.timestamp_millis(F.col("ts_ms").cast("long"))).withWatermark("event_time", late)
    out = rows.groupBy(F.window("event_time", size).alias("w"), "node_id").agg(F.count("*").alias("hits"), (F.sum("delta_us") / 1000).alias("ms"))
    return out.select(F.col("w.start").alias("window_start"), "node_id", "hits", "ms")


def feed(spark, folder: str) -> DataFrame:
    """A stream of events from JSON lines that are dropped into a folder; broken lines are left out."""
    kind = "seq long, channel string, eventType string, context string, timestamp double, duration double, operationId string, error struct<message:string>"
    rows = spark.readStream.schema(kind).option("mode", "PERMISSIVE").json(folder)
    return rows.filter("channel IS NOT NULL AND timestamp IS NOT NULL").select(
        F.coalesce("seq", F.lit(0)).alias("seq"), "channel", F.col("eventType").alias("event_type"), F.col("timestamp").alias("ts_ms"), F.col("operationId").alias("operation_id"),
        F.col("duration").alias("duration_ms"), F.col("context").alias("context_json"), F.col("error.message").alias("error_message"),
    )

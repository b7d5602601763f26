"""Events as span exports, spans as events, and batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.loading import CHANNEL_ATTRIBUTE


def _nano(ms: Column) -> Column:
    return (F.round(ms).cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(30,0)").cast("string")


def event_spans(events: DataFrame, channel_attribute: str = CHANNEL_ATTRIBUTE) -> DataFrame:
    """A span per event: its context's plain values as attributes, its ids padded to their length."""
    context = F.from_json(F.coalesce("context_json", F.lit("{}")), "map<string,string>")
    values = F.map_entries(F.map_filter(context, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]")))
    attribute = lambda k, v: F.struct(k.alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    attributes = F.concat(F.transform(values, lambda e: attribute(e["key"], e["value"])), F.array(attribute(F.lit(channel_attribute), F.col("channel"))))
    failed = F.col("event_type") == "error"
    whole = F.coalesce(F.round("duration_ms"), F.lit(0.0))
    return events.select(
        "seq",
        F.coalesce(context["traceId"], F.lit("0" * 32)).alias("traceId"),
        F.rpad(F.coalesce("operation_id", F.lit("")), 16, "0").alias("spanId"),
        F.coalesce(context["parentSpanId"], F.lit("")).alias("parentSpanId"),
        F.col("channel").alias("name"), F.lit(1).alias("kind"), _nano(F.col("ts_ms")).alias("startTimeUnixNano"), _nano(F.round("ts_ms") + whole).alias("endTimeUnixNano"), attributes.alias("attributes"),
        F.struct(F.when(failed, 2).otherwise(1).alias("code"), F.when(failed, F.coalesce("error_message", F.lit("error"))).alias("message")).alias("status"),
    )


def exports(events: DataFrame, by: str, service: str = "node-app") -> DataFrame:
    """(by, json): one span export per value of `by`. Choose one that bounds a document, such as a trace or a minute."""
    spans = event_spans(events).join(events.select("seq", by), "seq")
    fields = [c for c in spans.columns if c not in ("seq", by)]
    grouped = spans.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("span")))), lambda e: e["span"]).alias("spans"))
    name = F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))
    scope = F.struct(F.struct(F.lit("tracequill").alias("name"), F.lit("1.0.0").alias("version")).alias("scope"), F.col("spans").alias("spans"))
    resource = F.struct(F.struct(F.array(name).alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))
    return grouped.select(by, F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("json"))


def events_json(events: DataFrame, folder: str) -> None:
    """Events as JSON lines, in the shape that the readers take."""
    error = F.when(F.col("error_message").isNotNull(), F.struct(F.col("error_message").alias("message")))
    events.select("channel", F.col("event_type").alias("eventType"), F.col("ts_ms").alias("timestamp"), F.col("duration_ms").alias("duration"), F.col("operation_id").alias("operationId"), F.col("context_json").alias("context"), error.alias("error")).write.json(folder)


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 1.0):
    """Hands the new events of a stream to `write` in batches, a second apart by default."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

"""Live feeds: counters, rates, frames of the latest rows, chunked downloads, paging and displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import memory


def channel_counts(events: DataFrame, most: int = 50) -> DataFrame:
    """The channels with the most events."""
    return events.groupBy("channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(most)


def rates(events: DataFrame, series: str) -> DataFrame:
    """(series, error_rate in percent, event_rate): what alert rules see of each series of events."""
    failed = F.count_if(F.lower("event_type").contains("error"))
    return events.groupBy(F.col(series).alias("series")).agg((failed / F.count("*") * 100).alias("error_rate"), F.count("*").cast("double").alias("event_rate"))


def live_alerts(samples: DataFrame, events: DataFrame, series: str, rules: DataFrame) -> DataFrame:
    """Alerts of each series from its last samples and its events."""
    return memory.fired(rules, memory.metrics(samples, rates(events, series)))


def last_rows(rows: DataFrame, series: str, most: int, order: str = "ts_ms") -> DataFrame:
    """The latest rows of each series."""
    back = Window.partitionBy(series).orderBy(F.desc(order))
    return rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= most).drop("_back")


def trailing(rows: DataFrame, series: str, ms: float = 120_000.0) -> DataFrame:
    """Rows of each series no older than ms before its latest."""
    latest = F.max("ts_ms").over(Window.partitionBy(series))
    return rows.withColumn("_latest", latest).filter(F.col("ts_ms") >= F.col("_latest") - ms).drop("_latest")


def reassemble(chunks: DataFrame, by: str = "transfer") -> DataFrame:
    """chunks (by, idx, total, data) -> (by, content, complete): pieces in order; complete if all have come, each counted once."""
    one = chunks.groupBy(by, "idx").agg(F.first("data").alias("data"), F.max("total").alias("total"))
    pieces = F.array_sort(F.collect_list(F.struct("idx", "data")))
    return one.groupBy(by).agg(F.array_join(F.transform(pieces, lambda p: p["data"]), "").alias("content"), (F.count("*") == F.max("total")).alias("complete"))


def messages(raw: DataFrame) -> DataFrame:
    """raw (json) -> (kind, channel, event_type, ts_ms, heap_used, level, message) of feed messages, whichever way they are nested."""
    at = lambda *paths: F.coalesce(*(F.get_json_object("json", p) for p in paths))
    named = lambda *names: at(*(f"$.data.{n}" for n in names), *(f"$.payload.{n}" for n in names), *(f"$.{n}" for n in names))
    return raw.select(
        F.lower(at("$.type", "$.kind")).alias("kind"), named("channel").alias("channel"), named("eventType", "event").alias("event_type"), named("timestamp", "ts").try_cast("double").alias("ts_ms"),
        named("heapUsed", "heap_used").try_cast("long").alias("heap_used"), named("level").alias("level"), named("message").alias("message"),
    )


def page(rows: DataFrame, order: list[Column | str], first: int, size: int) -> DataFrame:
    """`size` rows from place `first` on, in order."""
    return rows.orderBy(*order).offset(first).limit(size)


def by_channel(events: DataFrame) -> DataFrame:
    """(channel, seqs): the events of each channel by arrival; use it for bounded traces only."""
    return events.groupBy("channel").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


def by_operation(events: DataFrame) -> DataFrame:
    """(operation_id, seqs): the events of each operation by arrival."""
    return events.filter("operation_id IS NOT NULL").groupBy("operation_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


def stats_of_all_channels(stats: DataFrame, events: DataFrame) -> DataFrame:
    """Channel statistics with a row of zeros for channels that have events but no operation."""
    seen = events.filter("channel <> ''").select("channel").distinct()
    return seen.join(stats, "channel", "left").na.fill(0)


def kept_events(events: DataFrame, most: int = 250_000) -> DataFrame:
    """What a display keeps of a long trace: the first rows; statistics are made from all of them."""
    return events.orderBy("ts_ms", "seq").limit(most)


def severity_totals(issues: DataFrame) -> DataFrame:
    """(severity, n) of a validator's issues."""
    return issues.groupBy("severity").agg(F.sum("n").alias("n")) if "n" in issues.columns else issues.groupBy("severity").agg(F.count("*").alias("n"))


def prompt_lines(spans: DataFrame, most: int) -> DataFrame:
    """(id, line): the longest spans in words, with their share of their parent's time."""
    up = spans.select(F.col("id").alias("parent_id"), F.col("duration_ms").alias("_parent"))
    rows = spans.join(up, "parent_id", "left").orderBy(F.desc("duration_ms"), "id").limit(most)
    share = F.round(F.col("duration_ms") / F.col("_parent") * 1000) / 10
    line = F.concat(F.col("channel"), F.lit(" "), F.format_string("%.1fms", F.round("duration_ms", 1)), F.when(F.col("_parent") > 0, F.format_string(" (%.1f%% of parent)", share)).otherwise(""), F.when(F.col("status") == "error", " [error]").otherwise(""))
    return rows.select("id", line.alias("line"))

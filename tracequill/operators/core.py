"""Normalising, pairing, statistics, search, time series, comparison, validation and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import operation_key, percent_change, percentile
from .ranks import percentiles
from ..schema import EVENT_TYPES, SPAN_TYPES

# Patterns of channels.
SQL_CHANNEL = "(?i)(mysql|pg|postgres|sqlite|mssql|query|knex|sequelize)"
LOOP_CHANNEL = r"(?i)event[\s-]?loop"
CHANNEL_NAME = r"^[a-z0-9_-]+(\/[a-z0-9_-]+)?:[a-z0-9_.-]+$"


def normalize(events: DataFrame) -> DataFrame:
    """Events with a channel, a type and a time. Order is by (ts_ms, seq) wherever it matters."""
    return events.filter("channel <> '' AND event_type <> '' AND ts_ms IS NOT NULL")


def validity(events: DataFrame) -> DataFrame:
    """Counts of strictly valid and invalid events."""
    good = F.coalesce(
        (F.length("channel") > 0) & F.col("event_type").isin(*EVENT_TYPES) & ~F.isnan("ts_ms") & F.col("ts_ms").isNotNull(), F.lit(False)
    )
    return events.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"))


def pair_operations(events: DataFrame) -> DataFrame:
    """Operations of start, end and error events of one key in time order.

    An end or error closes the start right before it; without one it is an orphan of duration 0.
    A start without a following event is incomplete; one followed by another start vanishes. The
    channel is the closing event's. Only ends give an end time.
    """
    rows = normalize(events).filter(F.col("event_type").isin(*SPAN_TYPES)).withColumn("op_key", operation_key())
    by_key = Window.partitionBy("op_key").orderBy("ts_ms", "seq")
    rows = rows.withColumn("prev", F.lag(F.struct("event_type", "ts_ms")).over(by_key)).withColumn("next", F.lead("event_type").over(by_key))
    closing = F.col("event_type") != "start"
    paired = closing & F.coalesce(F.col("prev.event_type") == "start", F.lit(False))
    status = F.when(F.col("event_type") == "error", "error").when(paired, "success").otherwise("incomplete")
    extra = [c for c in events.columns if c not in ("ts_ms", "event_type", "operation_id", "duration_ms", "channel", "seq", "context_json")]
    return rows.filter(closing | F.col("next").isNull()).select(
        "op_key",
        "channel",
        F.when(paired, F.col("prev.ts_ms")).otherwise(F.col("ts_ms")).alias("start_ms"),
        F.when(F.col("event_type") == "end", F.col("ts_ms")).alias("end_ms"),
        F.when(paired, F.col("ts_ms") - F.col("prev.ts_ms")).otherwise(0.0).alias("duration_ms"),
        status.alias("status"),
        "seq",
        *extra,
    )


def _durations(accuracy: int | None = None) -> list:
    d = "CASE WHEN duration_ms > 0 THEN duration_ms END"
    return [
        F.round(F.coalesce(F.avg(F.expr(d)), F.lit(0.0)), 6).alias("avg_ms"),
        *(F.round(F.coalesce(percentile(p / 100, d, accuracy), F.lit(0.0)), 6).alias(f"p{p}_ms") for p in (50, 95, 99)),
        F.round(F.coalesce(F.min(F.expr(d)), F.lit(0.0)), 6).alias("min_ms"),
        F.round(F.coalesce(F.max(F.expr(d)), F.lit(0.0)), 6).alias("max_ms"),
    ]


def channel_stats(ops: DataFrame, accuracy: int | None = None, ranked: bool = False) -> DataFrame:
    """Per channel: counts by status, and statistics of the durations over 0.

    ranked: the same percentiles, from ranges of the durations over many tasks, for channels with more
    distinct durations than one task can hold.
    """
    counts = (F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "error", "incomplete")))
    if not ranked:
        return ops.groupBy("channel").agg(*counts, *_durations(accuracy))
    plain = ops.groupBy("channel").agg(*counts, *_durations(1))
    exact = percentiles(ops.filter("duration_ms > 0"), ["channel"], "duration_ms", {f"_p{p}": p / 100 for p in (50, 95, 99)})
    rows = plain.join(exact, "channel", "left")
    return rows.select(*(F.round(F.coalesce(f"_{c[:-3]}", F.lit(0.0)), 6).alias(c) if c in ("p50_ms", "p95_ms", "p99_ms") else c for c in plain.columns))


def summary(events: DataFrame, ops: DataFrame) -> DataFrame:
    """One row: events, operations, error rate, time range, number of channels and their sorted list."""
    e = normalize(events).agg(
        F.count("*").alias("total_events"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
    )
    o = ops.agg(F.count("*").alias("total_operations"), F.count_if(F.col("status") == "error").alias("errors"))
    rate = F.when(F.col("total_operations") > 0, F.col("errors") / F.col("total_operations")).otherwise(0.0)
    return e.join(o, how="cross").withColumn("error_rate", F.round(rate, 9)).drop("errors")  # one row and one row


def filter_channels(events: DataFrame, channels: list[str]) -> DataFrame:
    """Events of the channels; all of them for an empty list."""
    return events.filter(F.col("channel").isin(channels)) if channels else events


def search_text(events: DataFrame, pattern: str, literal: bool = False, match_case: bool = False) -> DataFrame:
    """Events whose channel, context or operation id match, as JSON text. Literal patterns match as they are; one that is no regular expression filters nothing."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    own = F.when(F.col("operation_id").isNull(), "").otherwise(F.concat(F.lit(',"operationId":'), quoted("operation_id")))
    body = F.concat(F.lit('{"channel":'), quoted("channel"), F.lit(',"context":'), F.coalesce("context_json", F.lit("{}")), own, F.lit("}"))
    if literal:
        return events.filter(body.contains(pattern) if match_case else F.lower(body).contains(pattern.lower()))
    try:
        events.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # the JVM's syntax error
        return events
    return events.filter(body.rlike(pattern if match_case else f"(?i){pattern}"))


def filter_by_operation(events: DataFrame, ops: DataFrame, condition: str) -> DataFrame:
    """Events of operations that meet the condition; events without an operation id pass."""
    kept = ops.filter(condition).select(F.col("op_key").alias("operation_id")).distinct()
    return events.filter("operation_id IS NOT NULL").join(kept, "operation_id", "left_semi").unionByName(events.filter("operation_id IS NULL").select("operation_id", *[c for c in events.columns if c != "operation_id"]))


def operations_of(ops: DataFrame, events: DataFrame) -> DataFrame:
    """Operations with an event of their id among the events."""
    ids = events.filter("operation_id IS NOT NULL").select(F.col("operation_id").alias("op_key")).distinct()
    return ops.join(ids, "op_key", "left_semi")


def throughput(events: DataFrame, most: int = 50) -> DataFrame:
    """Events per half-open time bucket: min(most, ceil(events / 10)) buckets; the last moment falls out."""
    span = events.agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"), F.least(F.lit(most), F.ceil(F.count("*") / 10)).cast("int").alias("n"))
    grid = span.filter("n > 0").select("t0", "n", ((F.col("t1") - F.col("t0")) / F.col("n")).alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"))
    one = span.select("t0", "n", ((F.col("t1") - F.col("t0")) / F.col("n")).alias("width"))
    rows = events.select("ts_ms").join(F.broadcast(one), how="cross")  # one row
    counts = rows.filter("width > 0").select(F.floor((F.col("ts_ms") - F.col("t0")) / F.col("width")).cast("int").alias("bucket")).groupBy("bucket").count()
    return grid.join(counts, "bucket", "left").select("bucket", (F.col("t0") + F.col("bucket") * F.col("width")).alias("from_ms"), F.coalesce("count", F.lit(0)).alias("n"))


def latency_histogram(ops: DataFrame, buckets: int = 30) -> DataFrame:
    """Operations per half-open bucket of duration over [0, max); the longest falls out."""
    d = ops.filter("duration_ms > 0")
    top = d.agg(F.max("duration_ms").alias("top"))
    rows = d.select("duration_ms").join(F.broadcast(top), how="cross")  # one row
    bucket = F.floor(F.col("duration_ms") / (F.col("top") / buckets)).cast("int")
    return rows.select(bucket.alias("bucket")).filter(F.col("bucket") < buckets).groupBy("bucket").agg(F.count("*").alias("n"))


def series_summary(events: DataFrame, ops: DataFrame) -> DataFrame:
    """One row: events per second over the range, mean and p95 of durations over 0."""
    e = events.agg(F.count("*").alias("n"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("seconds"))
    o = ops.filter("duration_ms > 0").agg(F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.round(percentile(0.95, "duration_ms"), 6).alias("p95_ms"))
    both = e.join(o, how="cross")  # one row and one row
    return both.select(F.round(F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(0.0), 9).alias("events_per_s"), "avg_ms", "p95_ms")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Channel statistics of two runs side by side, with percent changes; a channel of one run has zeros in the other."""
    cols = ("total", "error", "avg_ms", "p95_ms")
    a = before.select("channel", *(F.col(c).alias(f"{c}_a") for c in cols))
    b = after.select("channel", *(F.col(c).alias(f"{c}_b") for c in cols))
    both = a.join(b, "channel", "full_outer").na.fill(0)
    return both.withColumn("avg_change", F.round(percent_change(F.col("avg_ms_a"), F.col("avg_ms_b")), 6)).withColumn("p95_change", F.round(percent_change(F.col("p95_ms_a"), F.col("p95_ms_b")), 6))


def bottlenecks(ops: DataFrame) -> DataFrame:
    """Operations at or over the 95th percentile of all durations, and over 0."""
    cut = ops.agg(percentile(0.95, "duration_ms").alias("cut"))
    return ops.join(F.broadcast(cut), how="cross").filter("duration_ms >= cut AND duration_ms > 0").drop("cut")  # one row


def validate(events: DataFrame) -> DataFrame:
    """Issues (channel, severity, category, n): names, required fields, and unbalanced operations.

    Unbalanced operations are filed under what stands before the first colon of their key.
    """
    database = F.col("channel").startswith("mysql2:") | F.col("channel").startswith("pg:") | F.col("channel").startswith("redis:")
    bare = F.coalesce(F.json_array_length(F.to_json(F.json_object_keys("context_json"))), F.lit(0)) == 0
    checks = F.array_compact(
        F.array(
            F.when(~F.col("channel").rlike(CHANNEL_NAME), F.struct(F.lit("warning").alias("severity"), F.lit("naming").alias("category"))),
            F.when(F.col("ts_ms").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("required-field").alias("category"))),
            F.when(F.coalesce("event_type", F.lit("")) == "", F.struct(F.lit("error").alias("severity"), F.lit("required-field").alias("category"))),
            F.when(database & bare, F.struct(F.lit("warning").alias("severity"), F.lit("required-field").alias("category"))),
        )
    )
    single = events.withColumn("issue", F.explode(checks)).select("channel", "issue.severity", "issue.category")
    key = operation_key()
    pseudo = F.when(F.col("key").contains(":"), F.split("key", ":")[0]).otherwise("unknown")
    of = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    keys = events.groupBy(key.alias("key")).agg(of("start").alias("s"), of("end", "error").alias("e"), of("asyncStart").alias("a"), of("asyncEnd").alias("z"))
    open_ones = keys.filter("s > 0 AND s <> e").select(pseudo.alias("channel"), F.lit("warning").alias("severity"), F.lit("pairing").alias("category"))
    async_ones = keys.filter("a > 0 AND a <> z").select(pseudo.alias("channel"), F.lit("info").alias("severity"), F.lit("pairing").alias("category"))
    return single.unionByName(open_ones).unionByName(async_ones).groupBy("channel", "severity", "category").agg(F.count("*").alias("n"))


def validate_channels(events: DataFrame) -> DataFrame:
    """Per channel of events or issues: events, issues by severity, and whether no error was found."""
    issues = validate(events).groupBy("channel").agg(*(F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in ("error", "warning", "info")))
    seen = events.groupBy("channel").agg(F.count("*").alias("n_events"))
    return seen.join(issues, "channel", "full_outer").na.fill(0).withColumn("valid", F.col("n_error") == 0)


def n_plus_one(spans: DataFrame, threshold: int = 3, pattern: str = SQL_CHANNEL) -> DataFrame:
    """Parents (parent_id, channel) with `threshold` or more children of one SQL channel."""
    children = spans.filter(F.col("parent_id").isNotNull() & F.col("channel").rlike(pattern))
    return children.groupBy("parent_id", F.lower("channel").alias("channel")).agg(F.count("*").alias("queries")).filter(F.col("queries") >= threshold)


def gate(ops: DataFrame, events: DataFrame, repeats: DataFrame, p99_max: float = 500.0, loop_max: float = 20.0) -> DataFrame:
    """Rows (rule, status, actual, threshold): tail latency, repeated queries, event loop delay."""
    p99 = ops.filter("duration_ms > 0").agg(F.coalesce(percentile(0.99, "duration_ms"), F.lit(0.0)).alias("actual"))
    latency = p99.select(F.lit("p99-latency").alias("rule"), "actual", F.lit(float(p99_max)).alias("threshold"))
    n1 = repeats.agg(F.count("*").cast("double").alias("actual")).select(F.lit("n1-sql").alias("rule"), "actual", F.lit(0.0).alias("threshold"))
    delay = F.coalesce(*(F.get_json_object("context_json", f"$.{k}").try_cast("double") for k in ("latency", "delay", "lag")))
    loops = events.filter(F.col("channel").rlike(LOOP_CHANNEL)).withColumn("delay", delay).filter("delay > 0")
    loop = loops.agg(percentile(0.99, "delay").alias("actual")).select(F.lit("event-loop-delay").alias("rule"), "actual", F.lit(float(loop_max)).alias("threshold"))
    rows = latency.unionByName(n1).unionByName(loop)
    status = F.when(F.col("actual").isNull(), "skipped").when(F.col("actual") <= F.col("threshold"), "pass").otherwise("fail")
    return rows.select("rule", status.alias("status"), F.round(F.coalesce("actual", F.lit(0.0)), 6).alias("actual"), "threshold")

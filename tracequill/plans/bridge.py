"""The driver's tables as trace data.

Each row of `events` is an operation of channel app:<event_type> that lasts `value` milliseconds.
Operations under 10 ms have no end record, those from 480 ms no start record, so that open and
orphaned operations occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP_MS = 6 * 3600 * 1000.0
_MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts_ms."""
    return table(spark, sf_dir, "events").withColumn("ts_ms", F.expr(_MS))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = raw(spark, sf_dir)
    failed = F.col("event_type") == "error"

    def record(present, kind, ts, step):
        return F.when(present, F.struct((F.col("event_id") * 2 + step).alias("seq"), kind.alias("type"), ts.alias("ts")))

    start = record(F.col("value") < 480, F.lit("start"), F.col("ts_ms"), 0)
    end = record(F.col("value") >= 10, F.when(failed, "error").otherwise("end"), F.col("ts_ms") + F.col("value"), 1)
    rows = base.withColumn("r", F.explode(F.array_compact(F.array(start, end))))
    return rows.select(
        F.col("r.seq").alias("seq"),
        F.concat(F.lit("app:"), "event_type").alias("channel"),
        F.col("r.type").alias("event_type"),
        F.col("r.ts").alias("ts_ms"),
        F.col("event_id").cast("string").alias("operation_id"),
        F.col("value").alias("duration_ms"),
        F.col("props").alias("context_json"),
        F.when(F.col("r.type") == "error", F.concat(F.lit("failed "), "props")).alias("error_message"),
        "user_id",
    )


EV = """
ev AS (
  SELECT event_id * 2 AS seq, 'app:' || event_type AS channel, 'start' AS event_type, epoch_us(ts)::DOUBLE / 1000.0::DOUBLE AS ts_ms,
    event_id::VARCHAR AS operation_id, value AS duration_ms, props AS context_json, NULL::VARCHAR AS error_message, user_id
  FROM events WHERE value < 480
  UNION ALL
  SELECT event_id * 2 + 1, 'app:' || event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'end' END,
    epoch_us(ts)::DOUBLE / 1000.0::DOUBLE + value, event_id::VARCHAR, value, props,
    CASE WHEN event_type = 'error' THEN 'failed ' || props END, user_id
  FROM events WHERE value >= 10
)"""

OPS = EV + """,
seen AS (
  SELECT *, lag(event_type) OVER k AS prev_type, lag(ts_ms) OVER k AS prev_ms, lead(event_type) OVER k AS next_type
  FROM ev WHERE event_type IN ('start', 'end', 'error')
  WINDOW k AS (PARTITION BY operation_id ORDER BY ts_ms, seq)
),
op AS (
  SELECT operation_id AS op_key, channel,
    CASE WHEN event_type <> 'start' AND prev_type = 'start' THEN prev_ms ELSE ts_ms END AS start_ms,
    CASE WHEN event_type = 'end' THEN ts_ms END AS end_ms,
    CASE WHEN event_type <> 'start' AND prev_type = 'start' THEN ts_ms - prev_ms ELSE 0 END AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'end' AND prev_type = 'start' THEN 'success' ELSE 'incomplete' END AS status,
    seq, user_id
  FROM seen WHERE event_type <> 'start' OR next_type IS NULL
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw() with trace_id (user and session number) and the event before in the session."""
    by_user = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    rows = raw(spark, sf_dir).withColumn("before", F.lag("ts_ms").over(by_user))
    rows = rows.withColumn("fresh", F.when(F.col("before").isNull() | (F.col("ts_ms") - F.col("before") > GAP_MS), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("fresh").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("trace_id", F.concat_ws("-", "user_id", "session"))
    return rows.withColumn("previous", F.when(F.col("fresh") == 0, F.lag("event_id").over(by_user)))


SESSION = f"""
s0 AS (SELECT *, epoch_us(ts)::DOUBLE / 1000.0::DOUBLE AS ts_ms FROM events),
s1 AS (SELECT *, lag(ts_ms) OVER u AS before, lag(event_id) OVER u AS prior FROM s0 WINDOW u AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
s2 AS (SELECT *, CASE WHEN before IS NULL OR ts_ms - before > {GAP_MS} THEN 1 ELSE 0 END AS fresh FROM s1),
ses AS (
  SELECT *, user_id::VARCHAR || '-' || (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING))::BIGINT::VARCHAR AS trace_id,
    CASE WHEN fresh = 0 THEN prior END AS previous
  FROM s2
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per event: service its type, parent the event before in the session (or the trace's root).

    Odd ids hang off the event before, even ones off the session's first, so that spans have siblings.
    Purchases are producer spans.
    """
    rows = sessions(spark, sf_dir)
    first = Window.partitionBy("trace_id").orderBy("ts_ms", "event_id")
    rows = rows.withColumn("root", F.first("event_id").over(first))
    parent = F.when(F.col("previous").isNull(), F.lit(None)).when(F.col("event_id") % 2 == 1, F.col("previous")).otherwise(F.col("root"))
    return rows.select(
        "trace_id",
        F.col("event_id").cast("string").alias("span_id"),
        parent.cast("string").alias("parent_span_id"),
        F.col("event_type").alias("service"),
        F.concat(F.lit("GET /"), "event_type").alias("name"),
        F.when(F.col("event_type") == "purchase", 4).otherwise(2).alias("kind"),
        F.col("ts_ms").alias("start_ms"),
        (F.col("ts_ms") + F.col("value")).alias("end_ms"),
        (F.col("event_type") == "error").alias("error"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "props")).alias("error_message"),
    )


SPAN = SESSION + """,
s3 AS (SELECT *, first_value(event_id) OVER (PARTITION BY trace_id ORDER BY ts_ms, event_id) AS root FROM ses),
span AS (
  SELECT trace_id, event_id::VARCHAR AS span_id,
    (CASE WHEN previous IS NULL THEN NULL WHEN event_id % 2 = 1 THEN previous ELSE root END)::VARCHAR AS parent_span_id,
    event_type AS service, 'GET /' || event_type AS name, CASE WHEN event_type = 'purchase' THEN 4 ELSE 2 END AS kind,
    ts_ms AS start_ms, ts_ms + value AS end_ms, event_type = 'error' AS error,
    CASE WHEN event_type = 'error' THEN 'failed ' || props END AS error_message
  FROM s3
)"""

"""Queries of the streaming forms over finished inputs: the same functions that batches of a stream go through."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import memory
from ..streaming import rca, state
from . import q_causal, q_memory
from .bridge import raw
from .stages import shared_folder

WINDOW = 5 * 86_400_000.0
#: Added to the samples' times, some of which are below zero: a stream's watermark starts there.
EPOCH = 1e12


def _events(spark, d):
    value = raw(spark, d).select(F.col("event_id").cast("string").alias("operation_id"), F.col("value").alias("duration_ms"))
    return q_causal.events(spark, d).join(value, "operation_id")


def stream_findings(spark, d):
    rows = rca.findings(_events(spark, d), WINDOW, scope="user_id")
    return rows.select("id", "channel", *(F.round(c, 6).alias(c) for c in ("score", "confidence", "latency_ratio", "baseline_ms", "window_mean_ms", "window_error_rate")), F.array_join("signals", ",").alias("signals"), "open")


def stream_warnings(spark, d):
    return rca.warnings(_events(spark, d), WINDOW, factor=1.0, margin=0.0).withColumn("ratio", F.round("ratio", 6))


def _findings(rows):
    return rows.select("id", "channel", *(F.round(c, 6).alias(c) for c in ("score", "confidence", "latency_ratio", "baseline_ms", "window_mean_ms", "window_error_rate")), F.array_join("signals", ",").alias("signals"), "open")


def state_findings(spark, d):
    """The events as a stream of four batches in no order of time; what its state says in the end."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = _events(spark, d)
    events.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    state.watch(stream, f"{folder}/checkpoint", "user_id").awaitTermination()
    return _findings(state.verdicts_of(spark, f"{folder}/checkpoint", WINDOW, scope="user_id"))


def state_alerts(spark, d):
    """Memory samples as a stream of a quarter of the time each, unordered within; a last sample pushes the watermark past all."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    samples = q_memory.leak_samples(spark, d).select("series", (F.col("ts_ms") + EPOCH).alias("ts_ms"), "heap_used", "heap_total")
    low, high = samples.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    quarter = F.least(F.lit(3), F.floor((F.col("ts_ms") - low) / max((high - low) / 4, 1)))
    for k in range(4):
        samples.filter(quarter == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    end = samples.limit(1).select(F.lit("end").cast(samples.schema["series"].dataType).alias("series"), F.lit(high + 9e8).cast(samples.schema["ts_ms"].dataType).alias("ts_ms"), F.lit(0).cast(samples.schema["heap_used"].dataType).alias("heap_used"), F.lit(None).cast(samples.schema["heap_total"].dataType).alias("heap_total"))
    end.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    alerts = state.detect(stream, "1 minute", most_mb=16.0, rate_bps=memory.MIB / 4)
    alerts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(state.ALERT).parquet(f"{folder}/out").select("series", "rule", (F.col("ts_ms") - EPOCH).alias("ts_ms"), "level", "metric", "value", "streak")


QUERIES = {f.__name__: f for f in (stream_findings, stream_warnings, state_findings, state_alerts)}

_CH = q_causal.NODE + f""",
en AS (SELECT event_id::VARCHAR AS id, 'app:' || event_type AS channel, ts_ms + value * {q_causal.MINUTE} AS at_ms, value AS d, event_type = 'error' AS bad FROM ses WHERE value >= 10),
rf AS (SELECT max(at_ms) AS now FROM en),
ch AS (SELECT channel, count(*) AS n, quantile_disc(d, 0.25) AS base, coalesce(avg(d) FILTER (WHERE at_ms >= now - {WINDOW}), 0) AS mean, count(*) FILTER (WHERE bad)::DOUBLE / count(*) AS be,
  coalesce(count(*) FILTER (WHERE bad AND at_ms >= now - {WINDOW})::DOUBLE / nullif(count(*) FILTER (WHERE at_ms >= now - {WINDOW}), 0), 0) AS we FROM en, rf GROUP BY 1)"""
_SEED = _CH + """,
sd AS (SELECT m.id, m.channel, m.status, coalesce(e.d, 0) AS own, e.d IS NULL AS open, base, mean, we, base > 0 AND coalesce(e.d, 0) > base * 1.8 AS late, we > be + 0.02 AS spike FROM node m LEFT JOIN en e USING (id) LEFT JOIN ch ON ch.channel = m.channel),
b0 AS (SELECT *, greatest(CASE WHEN late THEN least(1, greatest(0, (own / base - 1) / 0.8::DOUBLE)) WHEN base = 0 AND own > 0 THEN 0.5 ELSE 0 END, CASE WHEN status = 'error' THEN 0.85::DOUBLE ELSE 0 END, CASE WHEN spike THEN least(1, we) ELSE 0 END) AS seed FROM sd),
x0 AS (SELECT id, seed, seed AS b FROM b0)""" + "".join(
    f", x{k} AS (SELECT s.id, s.seed, least(1, s.seed + coalesce(g.g, 0)) AS b FROM x0 s LEFT JOIN (SELECT parent_id, sum(x.b * 0.85::DOUBLE) AS g FROM edge JOIN x{k - 1} x ON x.id = child_id GROUP BY 1) g ON g.parent_id = s.id)" for k in range(1, 5)
)

ORACLE_SQL = {
    "stream_findings": f"""WITH {_SEED}, cl AS (SELECT least(1, count(*) FILTER (WHERE NOT open) / 3.0::DOUBLE) AS ev FROM sd), f AS (SELECT b0.*, ev, least(1, b0.seed + 0.6::DOUBLE * x4.b) AS score FROM b0 JOIN x4 USING (id), cl)
SELECT id, channel, round(score, 6) AS score, round(ev * score * CASE WHEN open THEN 0.6::DOUBLE ELSE 1 END, 6) AS confidence, round(CASE WHEN base > 0 THEN own / base WHEN own > 0 THEN 999 ELSE 0 END, 6) AS latency_ratio, round(base, 6) AS baseline_ms,
  round(mean, 6) AS window_mean_ms, round(we, 6) AS window_error_rate, concat_ws(',', CASE WHEN open THEN 'incomplete-open-span' END, CASE WHEN status = 'error' THEN 'high-error-count' END, CASE WHEN late THEN 'latency-spike' END, CASE WHEN spike THEN 'error-rate-spike' END) AS signals, open FROM f""",
    "stream_warnings": f"""WITH {_CH}, r AS (SELECT *, CASE WHEN base > 0 THEN mean / base ELSE 0 END AS ratio FROM ch), cl AS (SELECT least(1, count(DISTINCT id) / 3.0::DOUBLE) AS ev FROM en)
SELECT channel, CASE WHEN ratio >= 3 OR we > be + 0.1 THEN 'critical' ELSE 'warning' END AS severity, printf('latency %.1fx baseline (%.1fms vs %.1fms)', round(ratio, 1), round(mean, 1), round(base, 1)) AS message,
  ev * CASE WHEN ratio >= 3 THEN 1 ELSE 0.7::DOUBLE END AS confidence, round(ratio, 6) AS ratio FROM r, cl WHERE n >= 3 AND (ratio >= 1 OR we > be)""",
}
ORACLE_SQL["state_findings"] = ORACLE_SQL["stream_findings"]
ORACLE_SQL["state_alerts"] = f"""SELECT series::VARCHAR AS series, 'gc-pressure' AS rule, ts_ms, 'warning' AS level, 'churn' AS metric, churn_mb AS value, streak FROM ({q_memory.ORACLE_SQL["gc_pressure"]})
UNION ALL SELECT series::VARCHAR, 'leak-trend', ts_ms, level, metric, value, streak FROM ({q_memory.ORACLE_SQL["leak_trend"]})"""

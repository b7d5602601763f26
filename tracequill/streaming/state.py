"""Streams whose memory is state: the causal graph with its channels, and detectors over memory samples.

Nothing here reads a row twice. State is kept by transformWithState in RocksDB, under the query's checkpoint
in the shared folder; what it holds can be read at any time with Spark's state reader, without stopping
the stream. One query keeps keys of several kinds, so that a batch is dealt out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalars import operation_key, percentile
from ..operators import causal, memory
from ..plans.stages import saved
from ..schema import SPAN_TYPES
from . import rca
from .pairing import valid

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that a channel's samples are dealt into, so that a hot one is no single key, and keys that operations are dealt into.
PARTS, NODES = 16, 1024
#: Values handed to a state in one call.
MANY = 10_000
NODE = "id string, channel string, first_seq long, start_ms double, start_seq long, end_ms double, end_seq long, failed boolean, own double, declared string, trigger_id string, named_seq long, async_id string, scope string"
SAMPLE = "duration double, ts_ms double, failed boolean"
FIELDS = [f.split(" ")[0] for f in NODE.split(", ")]
TOTALS = "n long, errors long"
CHANGE = "kind string, name string, rows long"


def stateful(spark: SparkSession) -> None:
    """Sets the state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Graph(StatefulProcessor):
    """Keys (kind, name, part): `node` keys hold a part of the operations, `channel` keys a part of a channel's samples.

    A key costs a call of its own and a value another, so operations share keys and a batch adds its rows in
    few calls: a row an operation that it touches, folded from its events, and a row a sample. What the rows
    of an operation come to is worked out when the state is read. A limited number of samples is kept in maps.

    Every value carries the seq it comes from, so rows may arrive in any order and an end before its
    start: what is read is what a batch over all rows would choose.
    """

    def __init__(self, samples: int | None = None):
        self.most = samples

    def init(self, handle) -> None:
        self.node = handle.getListState("node", NODE)
        self.whole = handle.getListState("whole", SAMPLE)
        self.samples = handle.getMapState("samples", "seq long", SAMPLE)
        self.errors = handle.getMapState("errors", "seq long", "ts_ms double")
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if key[0] == "node":
            sizes = frame.groupby("id", sort=False).size()
            self._grow(frame)
            yield pd.DataFrame({"kind": key[0], "name": sizes.index, "rows": sizes.to_numpy()})
        else:
            self._sample(frame)
            yield pd.DataFrame({"kind": [key[0]], "name": [key[1]], "rows": [len(frame)]})

    def _grow(self, frame: pd.DataFrame) -> None:
        touched: dict[str, dict] = {}
        for r in frame.to_dict("records"):
            r = {k: None if v is None or v != v else v for k, v in r.items()}
            kept = touched.setdefault(r["id"], dict.fromkeys(FIELDS) | {"id": r["id"]})
            seq, start = int(r["seq"]), r["event_type"] == "start"
            if kept["first_seq"] is None or seq < kept["first_seq"]:
                kept |= {"first_seq": seq, "channel": r["channel"], "async_id": r["async_id"] if start else None}
            if start and (kept["start_seq"] is None or seq < kept["start_seq"]):
                kept |= {"start_seq": seq, "start_ms": r["ts_ms"], "declared": r["declared"], "trigger_id": r["trigger_id"], "named_seq": seq}
            if not start:
                if kept["start_seq"] is None and (kept["named_seq"] is None or seq < kept["named_seq"]):
                    kept |= {"declared": r["declared"], "trigger_id": r["trigger_id"], "named_seq": seq, "start_ms": r["ts_ms"]}
                if kept["end_seq"] is None or seq > kept["end_seq"]:
                    kept |= {"end_seq": seq, "end_ms": r["ts_ms"], "failed": r["event_type"] == "error", "own": r["duration_ms"] or 0.0}
            kept["scope"] = r["scope"]
        self._add(self.node, [tuple(kept.values()) for kept in touched.values()])

    @staticmethod
    def _add(state, values: list[tuple]) -> None:
        for k in range(0, len(values), MANY):
            state.appendList(values[k : k + MANY])

    def _sample(self, frame: pd.DataFrame) -> None:
        n, errors = self.totals.get() if self.totals.exists() else (0, 0)
        failed = (frame["event_type"] == "error").tolist()
        values = list(zip(frame["duration_ms"].astype("float64").fillna(0.0).tolist(), frame["ts_ms"].tolist(), failed, strict=True))
        n, errors = n + len(values), errors + sum(failed)
        self.totals.update((n, errors))
        if self.most is None:
            self._add(self.whole, values)
            return
        for seq, value in zip(frame["seq"].tolist(), values, strict=True):
            self.samples.updateValue((seq,), value)
            if value[2]:
                self.errors.updateValue((seq,), (value[1],))
        for ring, size in ((self.samples, n), (self.errors, errors)):
            if size > self.most:
                for seq in sorted(k[0] for k in ring.keys())[: -self.most]:  # noqa: SIM118  a state, no dict
                    ring.removeKey((seq,))

    def close(self) -> None:
        pass


def _dealt(events: DataFrame, scope: str | None) -> DataFrame:
    """A row for the operation of each event, and one for its channel if it is an end."""
    rows = valid(events).filter(F.col("event_type").isin(*SPAN_TYPES)).withColumn("id", operation_key())
    ends = F.col("event_type") != "start"
    own = F.struct(F.lit("node").alias("kind"), F.lit("").alias("name"), F.pmod(F.hash("id"), F.lit(NODES)).cast("int").alias("part"))
    channel = F.when(ends, F.struct(F.lit("channel").alias("kind"), F.col("channel").alias("name"), F.pmod(F.hash("id"), F.lit(PARTS)).cast("int").alias("part")))
    rows = rows.select(
        F.explode(F.array_compact(F.array(own, channel))).alias("k"), "id", "seq", "channel", "event_type", "ts_ms", "duration_ms", causal.context_id(causal.PARENT_KEYS).alias("declared"),
        causal.context_id(causal.TRIGGER_KEYS).alias("trigger_id"), causal.context_id(causal.ASYNC_KEYS).alias("async_id"), (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"),
    )
    return rows.select("k.*", *rows.columns[1:])


def watch(stream: DataFrame, checkpoint: str, scope: str | None = None, report=None, name: str | None = None, samples: int | None = None):
    """Keeps the causal graph and channel samples of a stream of events in state; a batch costs what its rows cost.

    report(changes, number) gets the keys that a batch touched, with its rows for each, and must read
    them. Late rows are kept, as there is no watermark. samples: how many of a channel's latest samples are
    kept, by default all, which batches are equal to. verdicts_of() reads what is held.
    """
    stateful(stream.sparkSession)
    changes = _dealt(stream, scope).groupBy("kind", "name", "part").transformWithStateInPandas(Graph(samples), CHANGE, "update", "none")
    query = changes.writeStream.foreachBatch(report or (lambda batch, number: batch.count())).outputMode("update").option("checkpointLocation", checkpoint)
    return (query.queryName(name) if name else query).trigger(availableNow=True).start()


def _held(spark: SparkSession, checkpoint: str, name: str, batch: int | None = None) -> DataFrame:
    """What is held under a name, as of a batch (the last one that is complete, if none is given)."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def _operations(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """A row an operation, from the rows that batches have added."""
    rows = _held(spark, checkpoint, "node", batch).select("list_element.*")
    named = F.struct("start_ms", "declared", "trigger_id")
    return rows.groupBy("id").agg(
        F.min_by("channel", "first_seq").alias("channel"), F.min_by("async_id", "first_seq").alias("async_id"), F.min("first_seq").alias("first_seq"), F.min("start_seq").alias("start_seq"),
        F.coalesce(F.min_by(named, "start_seq"), F.min_by(named, "named_seq")).alias("named"), F.max("end_seq").alias("end_seq"), F.max_by(F.struct("end_ms", "failed", "own"), "end_seq").alias("end"), F.max("scope").alias("scope"),
    ).select("id", "channel", "async_id", "first_seq", "start_seq", "named.*", "end_seq", "end.*", "scope")


def verdicts_of(spark: SparkSession, checkpoint: str, window_ms: float = 10_000.0, now: float | None = None, scope: str | None = None, batch: int | None = None, **options) -> DataFrame:
    """rca.findings() of all events a watch() has seen, from its state alone."""
    held = saved(_operations(spark, checkpoint, batch))
    status = F.when(F.col("end_seq").isNull(), "incomplete").when(F.col("failed"), "error").otherwise("success")
    nodes = held.select("id", "channel", "start_ms", "end_ms", status.alias("status"), F.col("start_seq").isNull().alias("unpaired"), F.col("first_seq").alias("seq"), "declared", "async_id", "trigger_id", *([F.col("scope").alias(scope)] if scope else []))
    own = held.filter("end_seq IS NOT NULL").select("id", "own")
    return rca.verdicts(nodes, own, channels_of(spark, checkpoint, window_ms, now, batch), scope, **options)


def cautions_of(spark: SparkSession, checkpoint: str, window_ms: float = 10_000.0, now: float | None = None, batch: int | None = None, **options) -> DataFrame:
    """rca.warnings() of all events a watch() has seen, from its state alone."""
    closed = _operations(spark, checkpoint, batch).agg(F.count("end_seq").alias("closed"))
    return rca.cautions(channels_of(spark, checkpoint, window_ms, now, batch), closed, **options)


def channels_of(spark: SparkSession, checkpoint: str, window_ms: float, now: float | None = None, batch: int | None = None, samples: int | None = None) -> DataFrame:
    """rca.channel_windows() from state: of each channel the samples of all its parts, or the latest `samples` of them."""
    name = F.col("key.name").alias("channel")
    rows = _held(spark, checkpoint, "samples", batch).select(name, F.col("user_map_key.seq").alias("seq"), "user_map_value.*")
    whole = _held(spark, checkpoint, "whole", batch).select(name, F.lit(None).cast("long").alias("seq"), "list_element.*")
    rows = rows.unionByName(whole)
    bad = _held(spark, checkpoint, "errors", batch).select(name, "user_map_value.ts_ms").unionByName(whole.filter("failed").select("channel", "ts_ms"))
    latest = rows.agg(F.max("ts_ms").alias("now")) if now is None else spark.range(1).select(F.lit(float(now)).alias("now"))
    if samples is not None:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("seq")))).filter(F.col("_place") <= samples)
    kept = rows.join(F.broadcast(latest), how="cross")  # one row
    recent = F.col("ts_ms") >= F.col("now") - window_ms
    c = kept.groupBy("channel").agg(percentile(0.25, "duration").alias("base"), F.avg(F.when(recent, F.col("duration"))).alias("mean"), F.count_if(recent).alias("_recent"))
    failed = bad.join(F.broadcast(latest), how="cross").filter(recent).groupBy("channel").agg(F.count("*").alias("_failed"))  # one row
    totals = _held(spark, checkpoint, "totals", batch).select(name, "value.*").groupBy("channel").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    c = c.join(totals, "channel").join(failed, "channel", "left")
    return c.select("channel", "n", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("mean", F.lit(0.0)).alias("mean"), (F.col("errors") / F.col("n")).alias("base_errors"), F.coalesce(F.try_divide(F.coalesce("_failed", F.lit(0)), F.col("_recent")), F.lit(0.0)).alias("window_errors"))


# ---- detectors over memory samples

POINT = "ts_ms double, heap_used double, heap_total double"
COUNTS = "pressure long, growth long"
ALERT = "series string, rule string, ts_ms double, level string, metric string, value double, streak long"


class Detectors(StatefulProcessor):
    """Per series: the points still to come in order, the last `size` ones, recent reclaims, and breaches in a row.

    Points wait until the watermark has passed them and are then taken by time, so what comes out is
    what a batch over all points gives, however they arrived within the watermark's delay.
    """

    def __init__(self, window_ms: int = 10_000, most_mb: float = 64.0, every: int = 5, rate_bps: float = 2 * memory.MIB, size: int = 20, sustained: int = 3, percent: float = 90.0):
        self.window_ms, self.most_mb, self.every = window_ms, most_mb, every
        self.rate_bps, self.size, self.sustained, self.percent = rate_bps, size, sustained, percent

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", POINT)
        self.points = handle.getListState("points", POINT)
        self.reclaims = handle.getListState("reclaims", "ts_ms double, mb double")
        self.counts = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        some = [(float(t), float(u), None if x is None or x != x else float(x)) for t, u, x in zip(frame["ts_ms"], frame["heap_used"], frame["heap_total"], strict=True)]
        self.waiting.appendList(some)
        for due in {int(min(p[0] for p in some)), int(max(p[0] for p in some))}:
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(p for p in held if p[0] <= mark), [p for p in held if p[0] > mark]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(min(p[0] for p in later)) + 1)
        else:
            self.waiting.clear()
        found = self._taken(key[0], due) if due else []
        if found:
            yield pd.DataFrame(found, columns=[f.split(" ")[0] for f in ALERT.split(", ")])

    def _taken(self, series: str, due: list[tuple]) -> list[tuple]:
        points = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        reclaims = [tuple(p) for p in self.reclaims.get()] if self.reclaims.exists() else []
        pressure, growth = self.counts.get() if self.counts.exists() else (0, 0)
        out = []
        for ts, used, total in due:
            drop = points[-1][1] - used if points else 0.0
            points = [*points, (ts, used, total)][-self.size :]
            if drop > memory.MIB:
                reclaims = [r for r in reclaims if int(r[0]) > int(ts) - self.window_ms] + [(ts, drop / memory.MIB)]
                churn = round(sum(r[1] for r in reclaims), 6)
                pressure = pressure + 1 if churn > self.most_mb else 0
                if pressure and pressure % self.every == 0:
                    out.append((series, "gc-pressure", ts, "warning", "churn", churn, pressure))
            rate, share = max(0.0, self._slope(points)), used / total * 100 if total and total > 0 else 0.0
            growth = growth + 1 if rate > self.rate_bps or share > self.percent else 0
            if growth >= self.sustained and growth % self.sustained == 0:
                fast = rate > self.rate_bps
                out.append((series, "leak-trend", ts, "critical" if fast else "warning", "heapGrowthRate" if fast else "heapUsedPercent", round(rate / memory.MIB if fast else share, 6), growth))
        self.points.put(points)
        if reclaims:
            self.reclaims.put(reclaims)
        self.counts.update((pressure, growth))
        return out

    @staticmethod
    def _slope(points: list[tuple]) -> float:
        """Bytes a second by least squares."""
        n = len(points)
        x0, y0 = sum(p[0] for p in points) / n, sum(p[1] for p in points) / n
        spread = sum((p[0] - x0) ** 2 for p in points)
        return sum((p[0] - x0) * (p[1] - y0) for p in points) / spread * 1000 if spread else 0.0

    def close(self) -> None:
        pass


def detect(samples: DataFrame, late: str = "10 seconds", **options) -> DataFrame:
    """A stream of samples (series, ts_ms, heap_used[, heap_total]) -> a stream of alerts of both detectors."""
    stateful(samples.sparkSession)
    total = F.col("heap_total").cast("double") if "heap_total" in samples.columns else F.lit(None).cast("double")
    rows = samples.select(F.col("series").cast("string").alias("series"), F.timestamp_millis(F.floor("ts_ms").cast("long")).alias("event_time"), F.col("ts_ms").cast("double").alias("ts_ms"), F.col("heap_used").cast("double").alias("heap_used"), total.alias("heap_total"))
    return rows.withWatermark("event_time", late).groupBy("series").transformWithStateInPandas(Detectors(**options), ALERT, "append", "eventtime")

"""Readers of trace files into the schemas the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import jit, loading, memory, signals
from . import sourcemap

_RAW = "seq long, channel string, eventType string, context string, timestamp double, duration double, operationId string, error struct<message:string,name:string,stack:string>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files, a task each; for one over 2 GB use lines."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_trace(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of JSON files of any accepted shape, with `file`, `format` and a seq that orders files and places."""
    return loading.load(_documents(spark, path), strict=strict)


def read_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Trace events from JSON arrays (one a file), or from JSON lines, which split over tasks.

    Rows that are no objects or lack a channel, a type or a time are left out; context stays JSON text.
    seq orders files and places in them; lines carry their own seq, and those without one go by a hash
    of the line, so that reading again gives the same.
    """
    if not lines:
        return read_trace(spark, path).drop("file", "format", "error_name", "error_stack", "error_code")
    rows = spark.read.schema(_RAW).json(path).filter("channel <> '' AND eventType <> '' AND timestamp IS NOT NULL")
    own = F.coalesce("seq", F.xxhash64("channel", "eventType", "context", "timestamp", "operationId").bitwiseAND((1 << 62) - 1))
    return rows.select(
        own.alias("seq"), "channel", F.col("eventType").alias("event_type"), F.col("timestamp").alias("ts_ms"), F.col("operationId").alias("operation_id"),
        F.col("duration").alias("duration_ms"), F.col("context").alias("context_json"), F.col("error.message").alias("error_message"),
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(series, seq, line): lines of text files with their place, the file as series."""
    return _documents(spark, path).select(F.col("file").alias("series"), F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))


def read_gc_log(spark: SparkSession, path: str) -> DataFrame:
    """Collector runs of logs; seq orders the lines of a file."""
    return memory.gc_entries(_lines(spark, path))


def read_jit_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of compiler logs, the file as series."""
    return jit.parse(_lines(spark, path))


def read_source_maps(spark: SparkSession, path: str) -> DataFrame:
    """Mappings of source map files, by file."""
    return sourcemap.mappings(_documents(spark, path).select(F.col("file").alias("map_id"), F.col("text").alias("json")))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Start and end events of the spans of OTLP JSON exports, one a file."""
    return signals.otlp_events(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def read_snapshot_history(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot records of a JSON array; those without an id, a time or sizes are left out."""
    kind = "array<struct<id:string,timestamp:double,label:string,beforeName:string,afterName:string,beforeSize:double,afterSize:double,newNodeCount:long,removedNodeCount:long,retainedSizeDelta:double,growthRate:double,flagged:boolean>>"
    rows = _documents(spark, path).select(F.col("file").alias("series"), F.explode(F.from_json("text", kind)).alias("s")).select("series", "s.*")
    rows = rows.filter("id IS NOT NULL AND timestamp IS NOT NULL AND beforeSize IS NOT NULL AND afterSize IS NOT NULL AND retainedSizeDelta IS NOT NULL AND flagged IS NOT NULL")
    return rows.select("series", "id", F.col("timestamp").alias("ts_ms"), "label", "beforeSize", "afterSize", F.col("retainedSizeDelta").alias("delta"), F.col("growthRate").alias("growth_rate"), "flagged")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Memory samples of a JSON array: numbers floored, ts for timestamp, the file as series."""
    kind = "array<struct<timestamp:double,ts:double,rss:double,heapTotal:double,heapUsed:double,external:double,arrayBuffers:double>>"
    files = spark.read.text(path, wholetext=True).withColumn("series", F.input_file_name())
    rows = files.select("series", F.explode(F.from_json("value", kind)).alias("s"))
    number = lambda c: F.floor(F.coalesce(F.col(f"s.{c}"), F.lit(0.0))).cast("double")
    rows = rows.select("series", F.floor(F.coalesce("s.timestamp", "s.ts")).cast("double").alias("ts_ms"), number("rss").alias("rss"), number("heapTotal").alias("heap_total"), number("heapUsed").alias("heap_used"), number("external").alias("external"))
    # A file of fewer than two samples is no series.
    n = F.count("*").over(Window.partitionBy("series"))
    return rows.filter("ts_ms IS NOT NULL").withColumn("_n", n).filter("_n >= 2").drop("_n")


def sample_interval(samples: DataFrame) -> DataFrame:
    """(series, samples, interval_ms): the mean time between samples."""
    return samples.groupBy("series").agg(F.count("*").alias("samples"), ((F.max("ts_ms") - F.min("ts_ms")) / (F.count("*") - 1)).alias("interval_ms"))


def read_cpu_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, samples) of CPU profiles, each with its file: ids, parents and functions; sampled node and microseconds since the last.

    Ids are those of their file; several files stay apart by `file`.
    """
    kind = "nodes array<struct<id:long,callFrame:struct<functionName:string,url:string,lineNumber:int>,children:array<long>>>, samples array<long>, timeDeltas array<long>"
    doc = _documents(spark, path).select("file", F.from_json("text", kind).alias("d"))
    flat = doc.select("file", F.explode("d.nodes").alias("n"))
    up = flat.select("file", F.explode("n.children").alias("id"), F.col("n.id").alias("parent"))
    first = up.groupBy("file", "id").agg(F.min("parent").alias("parent_id"))
    name = F.coalesce(F.nullif(F.col("n.callFrame.functionName"), F.lit("")), F.lit("(anonymous)"))
    nodes = flat.select("file", F.col("n.id").alias("id"), name.alias("function")).join(first, ["file", "id"], "left").select("file", "id", "parent_id", "function")
    pairs = doc.select("file", F.explode(F.arrays_zip("d.samples", "d.timeDeltas")).alias("p"))
    return nodes, pairs.select("file", F.col("p.samples").alias("node_id"), F.coalesce("p.timeDeltas", F.lit(0)).alias("delta_us"))


#: Rows of a file whose edge counts are summed before those of its blocks are.
SUM_BLOCK = 1 << 14


def running_total(rows: DataFrame, by: str, place: str, value: str, name: str, block: int = SUM_BLOCK) -> DataFrame:
    """rows with `name`: the sum of `value` over earlier places (0, 1, ...) of the same key.

    Sums of blocks are added up first, a row a block; then each block on its own, so one large key is many tasks.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / block))
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_block").agg(F.sum(value).alias("_sum"))
    bases = sums.select(by, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(by, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.withColumn("_own", own).join(bases, [by, "_block"]).withColumn(name, F.col("_base") + F.col("_own")).drop("_block", "_own", "_base")


def read_heap_snapshot(spark: SparkSession, path: str, block: int = SUM_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of heap snapshots, each with its file: strided arrays are cut by the fields that the file itself names.

    Ids are those of their file; several files stay apart by `file`. Edges lie in the order of their nodes, so
    a node's begin where the edge counts of the nodes before it add up to.
    """
    kind = "snapshot struct<meta:struct<node_fields:array<string>,node_types:array<string>,edge_fields:array<string>>>, nodes array<long>, edges array<long>, strings array<string>"
    doc = _documents(spark, path).select("file", F.from_json("text", kind).alias("d"))
    meta = "d.snapshot.meta"
    place = lambda fields, name: F.array_position(f"{meta}.{fields}", name).cast("int") - 1
    doc = doc.select(
        "file", F.col("d.nodes").alias("nodes"), F.col("d.edges").alias("edges"), F.col("d.strings").alias("strings"), F.size(f"{meta}.node_fields").alias("n"), F.size(f"{meta}.edge_fields").alias("m"),
        F.from_json(F.get(f"{meta}.node_types", 0), "array<string>").alias("types"), *(place("node_fields", c).alias(f"n_{c}") for c in ("id", "name", "type", "self_size", "edge_count")),
        *(place("edge_fields", c).alias(f"e_{c}") for c in ("name_or_index", "to_node")),
    )
    counted = lambda array, stride: F.sequence(F.lit(0), F.floor(F.size(array) / F.col(stride)).cast("int") - 1)

    def node(k):
        at = lambda c: F.get("nodes", k * F.col("n") + F.col(f"n_{c}"))
        return F.struct(k.cast("long").alias("k"), at("id").alias("id"), F.get("strings", at("name").cast("int")).alias("name"), F.get("types", at("type").cast("int")).alias("type"), at("self_size").alias("self_size"), at("edge_count").alias("edge_count"))

    def edge(e):
        at = lambda c: F.get("edges", e * F.col("m") + F.col(f"e_{c}"))
        return F.struct(e.cast("long").alias("seq"), at("name_or_index").alias("name"), (at("to_node") / F.col("n")).cast("long").alias("to_k"))

    # One pass over a file's arrays: what comes out of inline() are plain rows, without the arrays beside them.
    nodes = doc.filter(F.size("nodes") >= F.col("n")).select("file", F.inline(F.transform(counted("nodes", "n"), node)))
    raw = doc.filter(F.size("edges") >= F.col("m")).select("file", F.inline(F.transform(counted("edges", "m"), edge)))
    owners = running_total(nodes, "file", "k", "edge_count", "before", block).filter("edge_count > 0").select("file", F.col("id").alias("from_id"), F.explode(F.expr("sequence(before, before + edge_count - 1)")).alias("seq"))
    ends = nodes.select("file", F.col("k").alias("to_k"), F.col("id").alias("to_id"))
    edges = raw.join(owners, ["file", "seq"]).join(ends, ["file", "to_k"]).select("file", "from_id", "to_id", F.col("name").cast("string").alias("name"), "seq")
    return nodes.select("file", "id", "name", "type", "self_size"), edges

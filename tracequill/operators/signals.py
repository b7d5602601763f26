"""Early warnings, local root causes, noise regions, context differences, stack frames, OTLP spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NOISE_PREFIXES, noise_kind, percentile, time_to_ms


def early_warnings(ops: DataFrame, window_ms: float, factor: float = 1.8, margin: float = 0.02, least: int = 3) -> DataFrame:
    """Channels whose mean duration or error rate in the last window stands out from all their history.

    The baseline is the 25th percentile of durations; the reference time the latest operation's end.
    """
    rows = ops.withColumn("at", F.col("start_ms") + F.col("duration_ms"))
    now = rows.agg(F.max("at").alias("now"))
    rows = rows.join(F.broadcast(now), how="cross")  # one row
    recent = F.col("at") >= F.col("now") - window_ms
    bad = F.col("status") == "error"
    c = rows.groupBy("channel").agg(
        F.count("*").alias("n"),
        percentile(0.25, "duration_ms").alias("base"),
        F.coalesce(F.avg(F.when(recent, F.col("duration_ms"))), F.lit(0.0)).alias("mean"),
        (F.count_if(bad) / F.count("*")).alias("all_errors"),
        F.coalesce(F.try_divide(F.count_if(bad & recent), F.count_if(recent)), F.lit(0.0)).alias("recent_errors"),
    )
    c = c.withColumn("ratio", F.when(F.col("base") > 0, F.col("mean") / F.col("base")).otherwise(0.0))
    c = c.filter((F.col("n") >= least) & ((F.col("ratio") >= factor) | (F.col("recent_errors") > F.col("all_errors") + margin)))
    level = F.when((F.col("ratio") >= 3) | (F.col("recent_errors") > F.col("all_errors") + 0.1), "critical").otherwise("warning")
    return c.select("channel", level.alias("severity"), F.round("base", 6).alias("baseline_ms"), F.round("mean", 6).alias("window_mean_ms"), F.round("ratio", 6).alias("ratio"))


def local_cause(stats: DataFrame, ops: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """One row: the channel with the most time (mean by count), the slowest operation, and its share of the trace's time window.

    depths (op_key, depth): with it also the deepest failed operation.
    """
    top = stats.agg(F.max_by("channel", F.struct(F.col("avg_ms") * F.col("total"), "channel")).alias("channel"))
    window = F.max(F.coalesce("end_ms", F.col("start_ms") + F.col("duration_ms"))) - F.min("start_ms")
    share = F.when(window > 0, F.round(F.max("duration_ms") / window, 9)).otherwise(0.0)
    slow = ops.agg(F.max_by("op_key", F.struct("duration_ms", "op_key")).alias("slowest"), share.alias("share"))
    out = top.join(slow, how="cross")  # one row and one row
    if depths is not None:
        failed = ops.filter("status = 'error'").join(depths, "op_key").agg(F.max_by("op_key", F.struct("depth", -F.col("seq"))).alias("deepest_error"))
        out = out.join(failed, how="cross")  # one row and one row
    return out


def noise_regions(events: DataFrame, series: str, gap_ms: float = 50.0, pause_ms: float = 15.0, prefixes: dict = NOISE_PREFIXES) -> DataFrame:
    """(series, kind, first, last): runs of run-specific noise, and idle gaps behind finished events.

    A series of one event has none. Collector runs count from pause_ms on, and hide gaps. Of another run, events behind a wide gap are
    gaps until the first that is not; from there the run goes on to its end, whatever gaps it has.
    """
    by = Window.partitionBy(series).orderBy("ts_ms", *(["channel"] if "rel_ms" in events.columns else []), "seq")
    rows = events.withColumn("i", F.row_number().over(by) - 1).withColumn("kind", noise_kind(F.concat_ws("|", "channel", "event_type"), prefixes))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(series))).filter("_n > 1")
    rows = rows.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(by)).withColumn("before", F.lag("event_type").over(by))
    wide = F.coalesce((F.col("gap") > gap_ms) & F.col("before").isin("end", "asyncEnd", "error"), F.lit(False))
    fresh = F.coalesce(~F.col("kind").eqNullSafe(F.lag("kind").over(by)), F.lit(True))
    rows = rows.withColumn("wide", wide & ~F.col("kind").eqNullSafe(F.lit("gc-pause"))).withColumn("_stretch", F.sum(F.when(fresh | (F.col("i") == 0), 1).otherwise(0)).over(by))
    run = Window.partitionBy(series, "_stretch")
    begin = F.when(F.col("kind").isNotNull(), F.min(F.when(~F.col("wide"), F.col("i"))).over(run))
    rows = rows.withColumn("begin", begin).select(series, "i", "kind", "ts_ms", "wide", "_stretch", "begin")
    gaps = rows.filter("wide AND (begin IS NULL OR i < begin)").select(series, F.lit("inter-event-gap").alias("kind"), (F.col("i") - 1).alias("first"), F.col("i").alias("last"))
    islands = rows.filter("i >= begin").groupBy(series, "_stretch", "kind").agg(F.min("i").alias("first"), F.max("i").alias("last"), (F.max("ts_ms") - F.min("ts_ms")).alias("long"))
    islands = islands.filter((F.col("kind") != "gc-pause") | (F.col("long") >= pause_ms))
    return islands.select(series, "kind", "first", "last").unionByName(gaps)


def context_changes(pairs: DataFrame) -> DataFrame:
    """pairs (id, before_json, after_json) of flat contexts -> (id, key, before, after) of keys that differ."""
    read = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,string>")
    both = F.map_zip_with(read("before_json"), read("after_json"), lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    rows = pairs.select("id", F.explode(both).alias("key", "v"))
    return rows.filter(~F.col("v.before").eqNullSafe(F.col("v.after"))).select("id", "key", "v.before", "v.after")


def stack_frames(stacks: DataFrame) -> DataFrame:
    """stacks (id, stack) -> (id, place, function, file, line, col, filtered) of each line that begins with `at`.

    A frame is a name with its place in brackets, or a place alone; a place without line and column is
    kept as it stands. Filtered are frames of the runtime (no file, its own scripts, node: modules
    outside of node_modules) and native ones (native files, names with `::` or `*`).
    """
    rows = stacks.select("id", F.posexplode(F.split("stack", "\n")).alias("place", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter(F.col("text").startswith("at "))
    body = F.ltrim(F.substring("text", 4, 1 << 30))
    inside = F.regexp_extract(body, r"\(([^()]*)\)$", 1)
    bracketed = body.endswith(")") & body.contains("(")
    rows = rows.withColumn("spot", F.trim(F.when(bracketed, inside).otherwise(body))).withColumn("name", F.when(bracketed, F.trim(F.substr(body, F.lit(1), F.length(body) - F.length(inside) - 2))).otherwise(""))
    placed = F.col("spot").rlike(r":\d+:\d+$")
    number = lambda k: F.when(placed, F.element_at(F.split("spot", ":"), k).cast("int"))
    file = F.when(placed, F.regexp_replace("spot", r":\d+:\d+$", "")).otherwise(F.col("spot"))
    rows = rows.select("id", "place", F.when(F.col("name") == "", "[anonymous]").otherwise(F.col("name")).alias("function"), file.alias("file"), number(-2).alias("line"), number(-1).alias("col"))
    f = F.col("file")
    runtime = (f == "") | f.startswith("internal/") | f.startswith("node:internal/") | f.isin("[eval]", "<anonymous>") | (f.contains("node:") & ~f.contains("node_modules/"))
    native = f.contains("native") | F.col("function").contains("::") | F.col("function").contains("*")
    return rows.withColumn("filtered", runtime | native)


OTLP = (
    "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,"
    "startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int,message:string>>>>>>>"
)


def otlp_events(exports: DataFrame) -> DataFrame:
    """exports (json) -> start and end (error for status 2) events of every span, with its service."""
    doc = exports.select(F.from_json("json", OTLP).alias("d")).select(F.explode("d.resourceSpans").alias("r"))
    names = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    spans = doc.select(F.coalesce(F.get(names, 0)["value"]["stringValue"], F.lit("unknown")).alias("service"), F.explode("r.scopeSpans").alias("s")).select("service", F.explode("s.spans").alias("p"))
    last = F.when(F.col("p.status.code") == 2, "error").otherwise("end")
    two = F.array(F.struct(F.lit("start").alias("event_type"), time_to_ms(F.col("p.startTimeUnixNano")).alias("ts_ms")), F.struct(last.alias("event_type"), time_to_ms(F.col("p.endTimeUnixNano")).alias("ts_ms")))
    rows = spans.withColumn("e", F.explode(two))
    return rows.select("service", F.coalesce(F.nullif(F.col("p.name"), F.lit("")), F.lit("otel.span")).alias("channel"), F.col("p.spanId").alias("operation_id"), F.col("p.traceId").alias("trace_id"), F.col("p.parentSpanId").alias("parent_id"), "e.event_type", "e.ts_ms")

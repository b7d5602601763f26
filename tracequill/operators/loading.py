"""Trace documents of any accepted shape -> events: format sniffing, native arrays, three span export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import time_to_ms

NATIVE = (
    "array<struct<channel:string,eventType:string,context:string,timestamp:double,duration:double,operationId:string,"
    "error:struct<message:string,name:string,stack:string,code:string>>>"
)
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPANS = (
    "array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,operationName:string,kind:int,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,startTime:string,duration:double,attributes:{_ATTRIBUTES},status:struct<code:int,message:string>>>"
)
EXPORT = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:{_SPANS}>>>>, spans {_SPANS}, "
    f"data array<struct<process:struct<serviceName:string>,spans:{_SPANS}>>"
)
#: The attribute that names a span's channel, where an exporter writes one.
CHANNEL_ATTRIBUTE = "trace.channel"
#: Context keys that the span's own fields take over.
_OWN_KEYS = ("traceId", "kind", "statusMessage")


def without_bom(text: str = "text") -> Column:
    return F.regexp_replace(F.col(text), "^﻿", "")


def _is_array(text: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(text, path).startswith("["), F.lit(False))


def trace_format(text: Column) -> Column:
    """`ndv`, `otel` or `native` by the shape of a JSON text; null where it is no JSON."""
    obj = F.ltrim(text).startswith("{")
    otel = _is_array(text, "$.resourceSpans") | _is_array(text, "$.spans") | F.get_json_object(text, "$.data[0].spans").isNotNull()
    valid = F.expr("try_parse_json(_text) IS NOT NULL")
    return F.when(~valid, None).when(obj & F.coalesce(F.get_json_object(text, "$.format") == "ndv", F.lit(False)), "ndv").when(obj & otel, "otel").otherwise("native")


def sniffed(documents: DataFrame) -> DataFrame:
    """documents (file, text) with the text without a byte order mark, its format, and why it is refused if it is."""
    rows = documents.withColumn("_text", without_bom()).withColumn("format", trace_format(F.col("_text")))
    first = F.get(F.from_json("_text", NATIVE), 0)
    array = F.ltrim("_text").startswith("[")
    empty = F.col("_text").rlike(r"^\s*\[\s*\]\s*$")
    events = array & (empty | (first["channel"].isNotNull() & first["eventType"].isNotNull() & first["timestamp"].isNotNull()))
    why = (
        F.when(F.col("format").isNull(), "File is not valid JSON").when(F.col("format") == "ndv", "This is a binary trace marked as JSON: read it with read_ndv")
        .when((F.col("format") == "native") & ~F.coalesce(events, F.lit(False)), "Neither an array of events nor a span export")
    )
    return rows.withColumn("text", F.col("_text")).withColumn("refused", why).drop("_text")


def native_events(documents: DataFrame) -> DataFrame:
    """Events of native arrays, with the file and the place in it."""
    rows = documents.select("file", F.posexplode(F.from_json("text", NATIVE)).alias("pos", "e"))
    rows = rows.filter("e.channel <> '' AND e.eventType <> '' AND e.timestamp IS NOT NULL")
    return rows.select(
        "file", F.col("pos").cast("long").alias("pos"), F.col("e.channel").alias("channel"), F.col("e.eventType").alias("event_type"), F.col("e.timestamp").alias("ts_ms"),
        F.col("e.operationId").alias("operation_id"), F.col("e.duration").alias("duration_ms"), F.col("e.context").alias("context_json"),
        F.col("e.error.message").alias("error_message"), F.col("e.error.name").alias("error_name"), F.col("e.error.stack").alias("error_stack"), F.col("e.error.code").alias("error_code"),
    )


def _text_of(value: Column) -> Column:
    """An attribute's value as text; arrays and the like are empty."""
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"), F.lit(""))


def exported_spans(documents: DataFrame) -> DataFrame:
    """(file, g, s, k, service, span) of each span: resource groups, a flat list, or processes with spans."""
    doc = documents.select("file", F.from_json("text", EXPORT).alias("d"))
    service = lambda r: F.get(F.filter(r["resource"]["attributes"], lambda a: a["key"] == "service.name"), 0)["value"]["stringValue"]
    shape = lambda s, sets: F.struct(s.alias("service"), sets.alias("sets"))
    none = F.lit(None).cast("string")
    standard = F.transform("d.resourceSpans", lambda r: shape(service(r), F.transform(r["scopeSpans"], lambda x: x["spans"])))
    flat = F.when(F.col("d.spans").isNotNull(), F.array(shape(none, F.array("d.spans"))))
    processes = F.transform("d.data", lambda p: shape(p["process"]["serviceName"], F.array(p["spans"])))
    groups = doc.select("file", F.posexplode(F.coalesce(standard, flat, processes)).alias("g", "group"))
    sets = groups.select("file", "g", F.col("group.service").alias("service"), F.posexplode("group.sets").alias("s", "set"))
    return sets.select("file", "g", "s", "service", F.posexplode("set").alias("k", "span"))


def span_events(spans: DataFrame, channel_attribute: str = CHANNEL_ATTRIBUTE) -> DataFrame:
    """A start and an end (error for status 2) event of each span, its attributes as text in the context."""
    p = "span."
    attributes = F.transform(F.coalesce("span.attributes", F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), _text_of(a["value"]).alias("value")))
    rows = spans.withColumn("_given", attributes)
    named = F.get(F.filter("_given", lambda a: a["key"] == channel_attribute), 0)["value"]
    full = lambda c: F.nullif(c, F.lit(""))
    other = F.coalesce(full(F.col(p + "name")), full(F.col(p + "operationName")))
    stamped = F.coalesce(F.col(p + "startTimeUnixNano"), F.col(p + "endTimeUnixNano")).isNotNull()
    timed = lambda c: F.coalesce(time_to_ms(full(F.col(p + c))), F.lit(0.0))
    rows = rows.withColumn("_by_length", ~stamped & F.coalesce(F.col(p + "duration") > 0, F.lit(False)))
    rows = rows.withColumn("_start", F.when(F.col("_by_length"), timed("startTime")).otherwise(timed("startTimeUnixNano")))
    rows = rows.withColumn("_end", F.when(F.col("_by_length"), F.col("_start") + F.col(p + "duration") / 1e3).otherwise(timed("endTimeUnixNano")))
    parent = full(F.col(p + "parentSpanId"))
    service = full(F.col("service"))
    own = [(F.lit("parentSpanId"), parent), (F.lit("traceId"), F.col(p + "traceId")), (F.lit("kind"), F.col(p + "kind").cast("string")), (F.lit("statusMessage"), F.col(p + "status.message")), (F.lit("serviceName"), service)]
    fields = F.filter(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in own)), lambda e: e["value"].isNotNull())
    taken = F.concat(F.array(*(F.lit(k) for k in _OWN_KEYS)), F.transform(fields, lambda e: e["key"]))
    rows = rows.withColumn("_n", F.size("_given")).withColumn("_taken", taken)
    last = F.filter("_given", lambda a, i: ~F.exists(F.slice("_given", i + 2, F.greatest(F.col("_n"), F.lit(1))), lambda b: b["key"] == a["key"]))
    context = F.to_json(F.map_from_entries(F.concat(F.filter(last, lambda a: ~F.array_contains(F.col("_taken"), a["key"])), fields)))
    failed = F.coalesce(F.col(p + "status.code") == 2, F.lit(False))
    message = F.when(failed, F.coalesce(F.col(p + "status.message"), F.lit("OTel error")))
    two = F.array(
        F.struct(F.lit("start").alias("event_type"), F.col("_start").alias("ts_ms"), F.lit(None).cast("string").alias("error_message")),
        F.struct(F.when(failed, "error").otherwise("end").alias("event_type"), F.col("_end").alias("ts_ms"), message.alias("error_message")),
    )
    made = F.concat(F.lit("otel:"), F.hex(F.xxhash64("file", "g", "s", "k")))
    rows = rows.select(
        "file", "g", "s", "k", F.coalesce(full(named), other, F.lit("otel.span")).alias("channel"), F.coalesce(full(F.col(p + "spanId")), other, made).alias("operation_id"),
        F.greatest(F.col("_end") - F.col("_start"), F.lit(0.0)).alias("duration_ms"), context.alias("context_json"), F.posexplode(two).alias("half", "e"),
    )
    place = Window.partitionBy("file").orderBy("g", "s", "k", "half")
    return rows.select(
        "file", (F.row_number().over(place) - 1).cast("long").alias("pos"), "channel", "e.event_type", "e.ts_ms", "operation_id", "duration_ms", "context_json",
        "e.error_message", F.col("e.error_message").alias("error_name"), F.lit(None).cast("string").alias("error_stack"), F.lit(None).cast("string").alias("error_code"),
    )


def load(documents: DataFrame, channel_attribute: str = CHANNEL_ATTRIBUTE, strict: bool = True) -> DataFrame:
    """documents (file, text) -> events of every accepted format, with `format`, `file` and a seq that orders files and places.

    A document of another shape raises an error, or gives no events where strict is off.
    """
    rows = sniffed(documents)
    fine = F.col("refused").isNull()
    if strict:
        fine = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat("file", F.lit(": "), "refused")).cast("boolean"))
    rows = rows.filter(fine)
    native = native_events(rows.filter("format = 'native'")).withColumn("format", F.lit("native"))
    otel = span_events(exported_spans(rows.filter("format = 'otel'")), channel_attribute).withColumn("format", F.lit("otel"))
    files = documents.select("file").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("file")) - 1)  # names of files only
    both = native.unionByName(otel).join(files, "file")
    return both.withColumn("seq", F.shiftleft(F.col("_nth").cast("long"), 40) + F.col("pos")).drop("_nth", "pos")


def formats(documents: DataFrame) -> DataFrame:
    """(file, format, events): a document without events counts as native, whatever its shape."""
    n = load(documents, strict=False).groupBy("file").agg(F.count("*").alias("events"))
    rows = sniffed(documents).join(n, "file", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return rows.select("file", F.when(F.col("refused").isNull() & (F.col("events") == 0), "native").otherwise(F.col("format")).alias("format"), "events", "refused")

"""Queries of readers over files that Spark writes from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import files, json_array
from .bridge import EV, table, trace_events
from .stages import shared_folder


def array_events(spark, d):
    """Events written as JSON arrays, one a partition, and read back by ranges of 256 KB."""
    folder = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    rows = trace_events(spark, d)
    fields = F.struct("seq", "channel", F.col("event_type").alias("eventType"), F.col("ts_ms").alias("timestamp"), F.col("operation_id").alias("operationId"), F.from_json("context_json", "map<string,string>").alias("context"), F.col("error_message").alias("message"))
    json_array.write_arrays(rows, folder, F.to_json(fields))
    found = json_array.elements_as(json_array.read_elements(spark, folder, 1 << 18), "seq long, channel string, eventType string, timestamp double, operationId string, context string, message string")
    return found.select("seq", "channel", "eventType", F.round("timestamp", 3).alias("ts_ms"), "operationId", F.get_json_object("context", "$.k").alias("k"), "message")


def snapshot_edges(spark, d):
    """Line items as heap snapshots, one a supplier with ids of its own, read back as edges with their owners' names."""
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    line = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("i"), F.floor("l_quantity").cast("long").alias("size"), "l_returnflag")
    node = F.array(F.lit(0), F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.col("i"), F.col("size"), F.col("l_linenumber") % 3).cast("array<long>")
    edge = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda j: F.when(j <= F.col("l_linenumber") % 3, F.array(F.lit(2), j, ((F.col("i") - 1) / 2).cast("int") * 5).cast("array<long>")).otherwise(F.array().cast("array<long>"))))
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("x")))), lambda s: s["x"]))
    # A supplier has some hundred line items, however many suppliers there are.
    whole = line.groupBy("l_suppkey").agg(ordered(node).alias("nodes"), ordered(edge).alias("edges"))
    fields = F.struct(F.array(*map(F.lit, ("type", "name", "id", "self_size", "edge_count"))).alias("node_fields"), F.array(F.array(F.lit("object"))).alias("node_types"), F.array(*map(F.lit, ("type", "name_or_index", "to_node"))).alias("edge_fields"))
    document = F.to_json(F.struct(F.struct(fields.alias("meta")).alias("snapshot"), "nodes", "edges", F.array(F.lit("kept"), F.lit("returned")).alias("strings")))
    # One document a file.
    whole.select(document.alias("value"), "l_suppkey").write.partitionBy("l_suppkey").option("lineSep", "\n").text(folder)
    nodes, edges = files.read_heap_snapshot(spark, f"{folder}/*/*")
    mode = F.regexp_replace(F.regexp_extract("file", "l_suppkey=([^/]*)", 1), "%20", " ").alias("mode")
    named = nodes.select("file", F.col("id").alias("from_id"), F.col("name").alias("owner"), "self_size")
    return edges.join(named, ["file", "from_id"]).select(mode, "from_id", "to_id", "name", "owner", "self_size")


QUERIES = {"array_events": array_events, "snapshot_edges": snapshot_edges}
ORACLE_SQL = {
    "array_events": f"""WITH {EV} SELECT seq, channel, event_type AS "eventType", round(ts_ms, 3) AS ts_ms, operation_id AS "operationId", json_extract_string(context_json, '$.k') AS k, error_message AS message FROM ev""",
    "snapshot_edges": """WITH n AS (SELECT l_suppkey::VARCHAR AS mode, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, floor(l_quantity)::BIGINT AS s, l_returnflag AS f, l_linenumber % 3 AS c FROM lineitem)
SELECT mode, i AS from_id, (i - 1) // 2 + 1 AS to_id, j::VARCHAR AS name, CASE WHEN f = 'R' THEN 'returned' ELSE 'kept' END AS owner, s AS self_size FROM n, (SELECT unnest([1, 2]) AS j) WHERE j <= c""",
}

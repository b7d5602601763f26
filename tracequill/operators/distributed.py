"""Distributed traces: span trees, clock skew, service topology and root causes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, operation_key, percentile
from ..functions.text import ADVICE, NO_ADVICE, advice, evidence, symptom
from ..plans.stages import saved
from .trees import climb

STEP_MS = 0.001
DAMPING, ROUNDS = 0.85, 24


def link_spans(spans: DataFrame, order: str = "start_ms") -> DataFrame:
    """Spans, the first of those that share an id, with duration and the parent only where it is there."""
    first = Window.partitionBy("trace_id", "span_id").orderBy(order, "service", "name")
    rows = spans.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    ids = rows.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_there"))
    rows = rows.join(ids, ["trace_id", "parent_span_id"], "left")
    keep = F.col("_there") & (F.col("parent_span_id") != F.col("span_id"))
    return rows.withColumn("parent_span_id", F.when(keep, F.col("parent_span_id"))).drop("_there").withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0.0)))


def correct_skew(linked: DataFrame) -> DataFrame:
    """Spans with adjusted_start_ms and adjusted_end_ms: no span starts before its parent plus a step.

    Down a path this is the greatest of every ancestor's start plus a step for each level between.
    """
    walked = climb(linked, ["trace_id", "span_id"], "parent_span_id", {"adjusted": F.col("start_ms")}, {"adjusted": lambda mine, above, hops: F.greatest(mine, above + hops * STEP_MS)})
    rows = linked.join(walked.select("trace_id", "span_id", "adjusted", "depth"), ["trace_id", "span_id"])
    return rows.withColumn("adjusted_start_ms", F.col("adjusted")).withColumn("adjusted_end_ms", F.col("adjusted") + F.col("duration_ms")).drop("adjusted")


def service_edges(linked: DataFrame) -> DataFrame:
    """Calls between different services: number, traces, failures, durations, kind."""
    parent = linked.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("source"), F.col("kind").alias("p_kind"))
    calls = linked.join(parent, ["trace_id", "parent_span_id"]).filter(F.col("source") != F.col("service"))
    waits = F.col("kind").isin(4, 5) | F.col("p_kind").isin(4, 5)
    return calls.groupBy("source", F.col("service").alias("target")).agg(
        F.count("*").alias("calls"),
        F.count_if("error").alias("errors"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
        F.round(percentile(0.95, "duration_ms"), 6).alias("p95_ms"),
        F.when(F.bool_or(waits), "async").otherwise("sync").alias("kind"),
    )


def service_nodes(linked: DataFrame) -> DataFrame:
    """Per service: calls, traces, latency, failures, and health against the median of the services' p95."""
    n = linked.groupBy("service").agg(
        F.count("*").alias("calls"),
        F.count_distinct("trace_id").alias("traces"),
        F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
        *(F.round(percentile(p / 100, "duration_ms"), 6).alias(f"p{p}_ms") for p in (50, 95, 99)),
        F.round(F.max("duration_ms"), 6).alias("max_ms"),
        F.count_if("error").alias("errors"),
    )
    n = n.withColumn("error_rate", F.round(F.col("errors") / F.col("calls"), 9))
    # The upper median over services: one number each, so one small array.
    positive = F.array_sort(F.collect_list(F.when(F.col("p95_ms") > 0, F.col("p95_ms"))))
    middle = n.agg(positive.alias("a")).select(F.coalesce(F.get("a", F.floor(F.size("a") / 2).cast("int")), F.lit(0.0)).alias("median_p95"))
    n = n.join(F.broadcast(middle), how="cross")  # one row
    slow, slower = F.col("p95_ms") >= 1.5 * F.col("median_p95"), F.col("p95_ms") >= 3 * F.col("median_p95")
    some = F.col("median_p95") > 0
    high, moderate = F.col("error_rate") >= 0.05, F.col("error_rate") >= 0.01
    faulty = high | (moderate & some & slower)
    health = F.when(faulty, "faulty").when(moderate, "warning").when(some & slower, "faulty").when(some & slow, "warning").otherwise("healthy")
    signal = F.when(faulty | moderate, "error").when(some & slow, "latency").otherwise("throughput")
    return n.withColumn("health", health).withColumn("signal", signal)


def anomalies(skewed: DataFrame) -> DataFrame:
    """(service, baseline_ms, magnitude, unexplained): means over a service's spans.

    The baseline is the 25th percentile of durations; magnitude grows to 1 at three times it, plus
    0.15 for a failure; unexplained is time over 1.5 times the baseline that no child accounts for.
    """
    base = skewed.groupBy("service").agg(percentile(0.25, "duration_ms").alias("base"))
    length = F.greatest(F.col("adjusted_end_ms") - F.col("adjusted_start_ms"), F.lit(0.0))
    kids = skewed.filter("parent_span_id IS NOT NULL").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum(length).alias("inside"))
    rows = skewed.join(base, "service").join(kids, ["trace_id", "span_id"], "left")
    base_ms, d = F.col("base"), F.col("duration_ms")
    late = F.when(base_ms > 0, clamp((d / base_ms - 1) / 2)).otherwise(F.when(d > 0, 1.0).otherwise(0.0))
    magnitude = clamp(late + F.when(F.col("error"), 0.15).otherwise(0.0))
    own = F.greatest(F.col("adjusted_end_ms") - F.col("adjusted_start_ms") - F.coalesce("inside", F.lit(0.0)), F.lit(0.0))
    unexplained = F.when((base_ms > 0) & (d > base_ms * 1.5), clamp(own / F.greatest(base_ms, F.lit(1.0)))).when((base_ms == 0) & F.col("error"), 0.6).otherwise(0.0)
    return rows.groupBy("service").agg(F.round(F.first("base"), 6).alias("baseline_ms"), F.round(F.avg(magnitude), 6).alias("magnitude"), F.round(F.avg(unexplained), 6).alias("unexplained"))


def critical_paths(linked: DataFrame) -> DataFrame:
    """(trace_id, span_id, service, depth): from each trace's first root down the longest child, the earliest of equal ones."""
    siblings = Window.partitionBy("trace_id", "parent_span_id").orderBy(F.desc("duration_ms"), "start_ms", "span_id")
    kids = linked.filter("parent_span_id IS NOT NULL").withColumn("_r", F.row_number().over(siblings))
    roots = Window.partitionBy("trace_id").orderBy("start_ms", "span_id")
    tops = linked.filter("parent_span_id IS NULL").withColumn("_r", F.row_number().over(roots))
    marked = kids.unionByName(tops).withColumn("_best", F.col("_r") == 1)
    walked = climb(marked, ["trace_id", "span_id"], "parent_span_id", {"on_path": F.col("_best")}, {"on_path": lambda mine, above, _: mine & above})
    return walked.filter("on_path AND root IS NOT NULL").join(linked.select("trace_id", "span_id", "service"), ["trace_id", "span_id"]).select("trace_id", "span_id", "service", "depth")


def criticality(paths: DataFrame) -> DataFrame:
    """(service, criticality): the share of traces whose critical path includes the service."""
    total = paths.agg(F.count_distinct("trace_id").alias("total"))
    share = paths.groupBy("service").agg(F.count_distinct("trace_id").alias("n")).join(F.broadcast(total), how="cross")  # one row
    return share.select("service", F.round(F.col("n") / F.col("total"), 9).alias("criticality"))


def _blame(nodes: pd.DataFrame) -> pd.DataFrame:
    services = list(nodes["service"])
    callers = {s: list(c) for s, c in zip(services, nodes["callers"], strict=True)}
    seed = {s: float(m) for s, m in zip(services, nodes["magnitude"], strict=True)}
    whole = sum(seed.values())
    seed = {s: v / whole if whole > 0 else v for s, v in seed.items()}
    score = dict.fromkeys(services, 0.0)
    for _ in range(ROUNDS):
        score = {s: (1 - DAMPING) * seed[s] + DAMPING * sum(score[c] / max(1, len(callers[c])) for c in callers[s]) for s in services}
    top = max(score.values(), default=0.0)
    return pd.DataFrame({"service": services, "blame": [round(score[s] / top if top > 0 else score[s], 9) for s in services]})


def blame(edges: DataFrame, magnitude: DataFrame) -> DataFrame:
    """(service, blame): damped propagation over the calls, the largest 1.

    A service's score adds those of the services that call it, each divided by the number of its own
    callers. The service graph (tens of rows) is one group.
    """
    callers = edges.groupBy(F.col("target").alias("service")).agg(F.array_sort(F.collect_set("source")).alias("callers"))
    nodes = magnitude.select("service", "magnitude").join(callers, "service", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))
    return nodes.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_blame, "service string, blame double")


def root_causes(nodes: DataFrame, found: DataFrame, share: DataFrame, blamed: DataFrame) -> DataFrame:
    """Services by score, with what it is made of."""
    rows = nodes.select("service", "error_rate", "signal").join(found, "service").join(share, "service", "left").join(blamed, "service", "left").na.fill(0.0)
    score = 0.28 * F.col("unexplained") + 0.2 * clamp(F.col("magnitude")) + 0.15 * F.col("criticality") + 0.17 * F.least(F.lit(1.0), F.col("error_rate") * 5) + 0.2 * F.col("blame")
    rows = rows.withColumn("score", F.round(score, 6))
    # A row per service: the ranking is over a bounded set.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "service"))).select("service", "rank", "score", "signal", "magnitude", "unexplained", "criticality", "blame")


def cascade(edges: DataFrame, nodes: DataFrame, found: DataFrame, source: str, most: int = 6, deepest: int = 4, least: float = 0.12) -> DataFrame:
    """(step, service, depth, signal, impact, symptom): a service, then the anomalous services that call it, level by level.

    Within a level callers stand in the order of whom they call, then by name. A service's row per
    level: the frames stay as small as the service graph.
    """
    level = found.select("service", F.col("magnitude"))
    front = saved(nodes.filter(F.col("service") == source).select("service", F.lit(0).alias("depth"), F.lit(1).alias("_pos")))
    seen = front
    for depth in range(1, deepest + 1):
        called = front.select(F.col("service").alias("target"), "_pos")
        callers = edges.select(F.col("source").alias("service"), "target").join(called, "target").join(level.filter(F.col("magnitude") > least), "service").join(seen.select("service"), "service", "left_anti")
        callers = callers.groupBy("service").agg(F.min("_pos").alias("_pos"))
        front = saved(callers.select("service", F.lit(depth).alias("depth"), F.row_number().over(Window.orderBy("_pos", "service")).alias("_pos")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    steps = seen.withColumn("step", F.row_number().over(Window.orderBy("depth", "_pos"))).filter(F.col("step") <= most).join(level, "service", "left").na.fill(0.0, ["magnitude"])
    rows = steps.join(nodes.select("service", "calls", "errors", "error_rate", "p95_ms", "signal"), "service")
    signal = F.when(F.col("error_rate") >= 0.01, "error").otherwise(F.col("signal"))
    return rows.withColumn("signal", signal).select("step", "service", "depth", "signal", clamp(F.col("magnitude")).alias("impact"), symptom("signal", "calls", "errors", "error_rate", "p95_ms", "magnitude").alias("symptom"))


def explained(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """root_causes with the evidence for each service, in words."""
    rows = ranked.join(nodes.select("service", "calls", "errors", "error_rate", "p95_ms", "avg_ms"), "service")
    words = evidence("calls", "errors", "error_rate", "p95_ms", "avg_ms", "unexplained", "magnitude", "criticality", "blame")
    return rows.withColumn("evidence", words).drop("calls", "errors", "error_rate", "p95_ms", "avg_ms")


def confidence(told: DataFrame, spans: DataFrame) -> DataFrame:
    """explained() with `confidence` in the first service as the cause; null for the others.

    It grows with the lead of its score over the next one's, with the traces seen (five are enough)
    and with its pieces of evidence (three are enough), between 0.3 and 0.95.
    """
    traces = spans.agg(F.count_distinct("trace_id").alias("_traces"))
    after = F.lead("score", 1, 0.0).over(Window.orderBy("rank"))  # a row per service
    lead = F.greatest(F.lit(0.0), F.col("score") - after)
    share = 0.45 + 0.3 * F.least(F.lit(1.0), lead) + 0.15 * F.least(F.lit(1.0), F.col("_traces") / 5) + 0.1 * F.least(F.lit(1.0), F.size("evidence") / 3)
    held = F.greatest(F.lit(0.3), F.least(F.lit(0.95), share))
    rows = told.join(F.broadcast(traces), how="cross")  # one row
    return rows.withColumn("confidence", F.when(F.col("rank") == 1, F.round(held, 6))).drop("_traces")


def recommendations(ranked: DataFrame, spans: DataFrame) -> DataFrame:
    """(place, text): advice by what error messages say, then by the first service's signal, then what to treat as effects."""
    order = F.create_map(*(F.lit(v) for i, (_, text) in enumerate(ADVICE) for v in (text, i)))
    said = spans.filter("error AND error_message IS NOT NULL").select(F.explode(advice(F.col("error_message"))).alias("text")).distinct()
    said = said.select(order[F.col("text")].alias("place"), "text")
    first = ranked.filter("rank = 1")
    latency = F.concat(F.lit("Optimize the slowest path in "), "service", F.lit(": add caching, reduce N+1 calls, or move work off the critical path."))
    failing = F.concat(F.lit("Triage errors in "), "service", F.lit(": check its dependencies and error handling before touching downstream services."))
    head = first.select(F.lit(10).alias("place"), F.when(F.col("signal") == "latency", latency).when(F.col("signal") == "error", failing).alias("text")).filter("text IS NOT NULL")
    others = ranked.filter("rank BETWEEN 2 AND 4").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "service"))), lambda x: x["service"]), ", ").alias("others"))
    tail = first.join(others, how="cross").filter("others <> ''")  # one row and one row
    tail = tail.select(F.lit(11).alias("place"), F.concat(F.lit("Treat downstream services ("), "others", F.lit(") as effects until "), "service", F.lit(" is resolved.")).alias("text"))
    found = said.unionByName(head).unionByName(tail)
    last = F.when(F.count("*") == 0, F.array(F.struct(F.lit(12).alias("place"), F.lit(NO_ADVICE).alias("text")))).otherwise(F.collect_list(F.struct("place", "text")))
    return found.agg(last.alias("r")).select(F.inline("r"))  # a handful of sentences


def analyse(spans: DataFrame) -> dict[str, DataFrame]:
    """The whole pipeline: `spans` with corrected times, `nodes`, `edges`, `paths`, `causes`, `recommendations`."""
    linked = saved(link_spans(spans))
    skewed = saved(correct_skew(linked))
    nodes, edges, found = saved(service_nodes(linked)), saved(service_edges(linked)), saved(anomalies(skewed))
    paths = saved(critical_paths(linked))
    ranked = saved(root_causes(nodes, found, criticality(paths), blame(edges, found)))
    return {"spans": skewed, "nodes": nodes, "edges": edges, "paths": paths, "causes": confidence(explained(ranked, nodes), spans), "recommendations": recommendations(ranked, spans)}


def operation_spans(ops: DataFrame, events: DataFrame) -> DataFrame:
    """Operations as spans of distributed traces: ids, service and kind from the context of their first event."""
    at = lambda *keys: F.coalesce(*(F.nullif(F.get_json_object("context_json", f"$['{k}']"), F.lit("")) for k in keys))
    first = events.withColumn("op_key", operation_key()).groupBy("op_key").agg(F.min_by("context_json", "seq").alias("context_json"), F.max(F.when(F.col("event_type") == "error", F.col("error_message"))).alias("error_message"))
    rows = ops.drop("context_json", "error_message").join(first, "op_key")
    return rows.select(
        F.coalesce(at("traceId"), F.lit("untraced")).alias("trace_id"), F.col("op_key").alias("span_id"), at("parentSpanId").alias("parent_span_id"),
        F.coalesce(at("serviceName"), at("service.name"), F.lit("unknown")).alias("service"), F.col("channel").alias("name"), at("kind").try_cast("double").cast("int").alias("kind"),
        "start_ms", F.coalesce("end_ms", F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), (F.col("status") == "error").alias("error"), "error_message",
    )

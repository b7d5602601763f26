"""The performance gate as users run it: events in, rules out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import saved
from . import causal, core

#: The most of the 99th percentile in ms, queries of one kind under one parent that fail, and the most of the event loop's delay in ms.
DEFAULTS = {"p99MaxMs": 500.0, "n1SqlMaxCount": 3, "eventLoopDelayMaxMs": 20.0}


def span_tree(events: DataFrame, scope: str | None = None) -> DataFrame:
    """(id, parent_id, depth, place, channel) of the operations of events."""
    nodes = saved(causal.causal_nodes(events, scope))
    spans = causal.waterfall(causal.with_virtual(nodes, causal.causal_edges(nodes, scope), scope), scope)
    return spans.join(nodes.select("id", "channel"), "id")


def evaluate(events: DataFrame, config: dict | None = None, scope: str | None = None) -> DataFrame:
    """Rows (rule, status, actual, threshold) of a trace. config: DEFAULTS' keys; scope: a column that bounds where parents are looked for."""
    c = DEFAULTS | (config or {})
    events = saved(core.normalize(events))
    repeats = core.n_plus_one(span_tree(events, scope), threshold=int(c["n1SqlMaxCount"]))
    return core.gate(core.pair_operations(events), events, repeats, p99_max=float(c["p99MaxMs"]), loop_max=float(c["eventLoopDelayMaxMs"]))

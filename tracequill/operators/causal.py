"""Causal graphs of operations: nodes, parents by several kinds of evidence, healing, forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import operation_key
from ..schema import SPAN_TYPES
from ..plans.stages import saved
from .trees import climb

# Context keys that name a parent operation or an asynchronous context.
PARENT_KEYS = ("parentOperationId", "parentId", "parentSpanId", "parent_span_id")
ASYNC_KEYS, TRIGGER_KEYS = ("asyncId", "async_id"), ("triggerAsyncId", "trigger_async_id")


def context_id(keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds a text or a number; other values (true, lists, objects) are no ids."""

    def held(key: str) -> Column:
        text = F.get_json_object("context_json", f"$.{key}")
        # Texts that look like another kind of value count if they are quoted.
        other = text.rlike(r"^(true|false|\[.*|\{.*)$") & ~F.col("context_json").rlike(rf'"{key}"\s*:\s*"')
        return F.when((text != "") & ~other, text)

    return F.coalesce(*map(held, keys))


def causal_nodes(events: DataFrame, scope: str | None = None) -> DataFrame:
    """A node per operation key: the first start and the last end or error, in order of arrival (seq).

    The channel is that of its first record. An operation without a start begins at its first end and is `unpaired`. Parent and trigger are
    those of its first start, or first end where there is none; an asynchronous id registers only if
    the start came first. scope: a column that bounds where parents are looked for.
    """
    rows = events.filter(F.col("event_type").isin(*SPAN_TYPES)).withColumn("id", operation_key())
    starts, ends = F.col("event_type") == "start", F.col("event_type") != "start"
    first = F.struct(F.when(starts, 0).otherwise(1), "seq")
    nodes = rows.groupBy("id", *([scope] if scope else [])).agg(
        F.min_by("channel", "seq").alias("channel"),
        F.coalesce(F.min_by("ts_ms", F.when(starts, F.col("seq"))), F.min_by("ts_ms", F.when(ends, F.col("seq")))).alias("start_ms"),
        F.max_by("ts_ms", F.when(ends, F.col("seq"))).alias("end_ms"),
        F.coalesce(F.max_by(F.when(F.col("event_type") == "error", "error").otherwise("success"), F.when(ends, F.col("seq"))), F.lit("incomplete")).alias("status"),
        (F.count_if(starts) == 0).alias("unpaired"),
        F.min("seq").alias("seq"),
        F.min_by(context_id(PARENT_KEYS), first).alias("declared"),
        F.min_by(F.when(starts, context_id(ASYNC_KEYS)), F.col("seq")).alias("async_id"),
        F.min_by(context_id(TRIGGER_KEYS), first).alias("trigger_id"),
    )
    return nodes


def nearest_before(until: np.ndarray, need: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the latest earlier one whose `until` reaches its `need`, -1 where there is none; first: where runs that know nothing of each other begin.

    Every place points at the one before it, and on to where that points for as long as what it meets ends
    too early: what lies between two ends earlier still. Pointers of places that are not done are followed
    all at once, so a chain of rising ends takes a round per power of two of its length.
    """

    def follow(at: np.ndarray, want: np.ndarray, up: np.ndarray) -> np.ndarray:
        todo = np.flatnonzero(at >= 0)
        while len(todo := todo[(at[todo] >= 0) & (until[at[todo]] < want[todo])]):
            at[todo] = up[at[todo]]
        return at

    before = np.where(first, -1, np.arange(len(until)) - 1)
    longer = before.copy()
    follow(longer, until, longer)
    return longer if need is until else follow(before, need, longer)


def _nearest(nodes: DataFrame, scope: str | None, reach: str) -> DataFrame:
    """(id, parent_id): the latest earlier row of the scope that lasts to `reach` of this one or longer.

    Rows are cut into blocks by scope and start, whatever the size of a scope. What a block leaves open for
    later ones is a staircase: rows that last longer than all behind them. Staircases of a scope's blocks,
    a few rows each (as many as operations nest), are merged in order into what each block begins with;
    then every block is done on its own.
    """
    key = F.col(scope).cast("string") if scope else F.lit("")
    rows = nodes.select(F.coalesce(key, F.lit("")).alias("_scope"), "id", F.col("start_ms").cast("double").alias("start_ms"), "seq", F.coalesce(F.col("end_ms").cast("double"), F.lit(float("inf"))).alias("until"))
    count = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = saved(rows.repartitionByRange(count, "_scope", "start_ms", "seq").withColumn("_block", F.spark_partition_id()))
    behind = Window.partitionBy("_block", "_scope").orderBy(F.desc("start_ms"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    spread = rows.groupBy("_scope").agg(F.min("_block").alias("low"), F.max("_block").alias("high")).filter("low < high").select("_scope")
    stairs = rows.join(spread, "_scope", "left_semi").withColumn("_longest", F.max("until").over(behind)).filter("_longest IS NULL OR until > _longest")

    def carried(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_block", "start_ms", "seq"], kind="stable")
        held, out = frame.iloc[:0], []
        for block, own in frame.groupby("_block", sort=True):
            if len(held):
                out.append(held.assign(_block=block))
            held = pd.concat([held[held["until"] > own["until"].max()], own]) if len(held) else own
        return pd.concat(out) if out else held.iloc[:0]

    columns = "_scope string, id string, start_ms double, seq long, until double, _block int"
    open_rows = stairs.select(*(f.split(" ")[0] for f in columns.split(", "))).groupBy("_scope").applyInPandas(carried, columns)

    def sweep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_scope", "start_ms", "seq"], kind="stable")
        scopes = frame["_scope"].to_numpy(object)
        until = frame["until"].to_numpy(float)
        need = until if reach == "until" else frame["start_ms"].to_numpy(float)
        at = nearest_before(until, need, np.concatenate([[True], scopes[1:] != scopes[:-1]]))
        own = np.flatnonzero(frame["_own"].to_numpy(bool) & (at >= 0))
        ids = frame["id"].to_numpy(object)
        return pd.DataFrame({"id": ids[own], "parent_id": ids[at[own]]}, dtype=object)

    both = rows.withColumn("_own", F.lit(True)).unionByName(open_rows.withColumn("_own", F.lit(False)))
    return both.groupBy("_block").applyInPandas(sweep, "id string, parent_id string")


def containment(nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """(id, parent_id): the latest earlier operation of the scope that ends no earlier."""
    return _nearest(nodes, scope, "until")


def overlap_parents(ops: DataFrame, scope: str | None = None) -> DataFrame:
    """(id, parent_id) of the older sweep: the latest earlier operation still open when this one starts.

    Operations without an end (failed ones too) stay open for ever.
    """
    return _nearest(ops.select(F.col("op_key").alias("id"), "start_ms", "end_ms", "seq", *([scope] if scope else [])), scope, "start_ms")


def causal_edges(nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """(parent_id, child_id, kind, confidence), at most one a child.

    Evidence in order: a declared parent (a missing one is healed by a virtual node), the operation
    that registered the triggering asynchronous id (the last registrant), containment. Operations
    without a start that none of these gives a parent hang off a virtual node of their own.
    """
    nodes = nodes if hasattr(nodes, "_tq_path") else saved(nodes)  # read four times below
    known = nodes.select(F.col("id").alias("declared"), F.lit(True).alias("known"))
    linked = nodes.filter(~F.col("unpaired") & F.col("async_id").isNotNull()).groupBy(F.col("async_id").alias("trigger_id")).agg(F.max_by("id", "seq").alias("linked"))
    rows = nodes.withColumn("declared", F.when(F.col("declared") != F.col("id"), F.col("declared")))
    rows = rows.join(known, "declared", "left").join(linked, "trigger_id", "left").join(containment(nodes, scope).withColumnRenamed("parent_id", "around"), "id", "left")
    edge = lambda parent, kind: F.struct(parent.alias("parent_id"), F.lit(kind).alias("kind"))
    best = F.coalesce(
        F.when(F.col("known"), edge(F.col("declared"), "explicit-parent")),
        F.when(F.col("declared").isNotNull(), edge(F.concat(F.lit("virtual:"), "declared"), "gap-healed")),
        F.when(F.col("linked") != F.col("id"), edge(F.col("linked"), "async-context")),
        F.when(F.col("around").isNotNull(), edge(F.col("around"), "containment")),
        F.when(F.col("unpaired"), edge(F.concat(F.lit("virtual:orphan:"), "id"), "gap-healed")),
    )
    out = rows.withColumn("edge", best).filter("edge IS NOT NULL")
    sure = F.when(F.col("kind").isin("explicit-parent", "async-context"), "high").when(F.col("kind") == "containment", "medium").otherwise("low")
    return out.select("edge.parent_id", F.col("id").alias("child_id"), "edge.kind").withColumn("confidence", sure)


def with_virtual(nodes: DataFrame, edges: DataFrame, scope: str | None = None) -> DataFrame:
    """(id, parent_id, virtual, start_ms and the scope): the concrete nodes and the virtual ones their edges name."""
    keep = [scope] if scope else []
    real = saved(nodes.join(edges.select(F.col("child_id").alias("id"), "parent_id"), "id", "left").select("id", "parent_id", F.lit(False).alias("virtual"), "start_ms", *keep))
    made = real.filter(F.col("parent_id").startswith("virtual:")).groupBy(F.col("parent_id").alias("id")).agg(F.min("start_ms").alias("start_ms"), *(F.min(c).alias(c) for c in keep))
    made = made.join(nodes.select("id"), "id", "left_anti")
    return real.unionByName(made.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("virtual"), "start_ms", *keep))


def graph_counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, confidence, n) of the edges."""
    return edges.groupBy("kind", "confidence").agg(F.count("*").alias("n"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: edges, healed gaps, orphans (children of virtual nodes), and edges by confidence."""
    low = F.col("parent_id").startswith("virtual:")
    sure = [F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")]
    return edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "gap-healed").alias("gap_heals"), F.count_distinct(F.when(low, F.col("child_id"))).alias("orphans"), *sure)


def cycle_nodes(graph: DataFrame) -> DataFrame:
    """(id) of the nodes on a cycle of parents."""
    walked = climb(graph, ["id"], "parent_id", {}, {})
    return walked.filter("loop IS NOT NULL").select(F.col("loop").alias("id")).distinct()


def cycle_paths(graph: DataFrame) -> DataFrame:
    """(cycle, path): each cycle by its smallest node, from that node down to it again.

    Nodes of a cycle are few; the walk is a join a step, over the cycles' nodes only.
    """
    on = saved(cycle_nodes(graph))
    up = saved(graph.join(on, "id", "left_semi").select("id", F.col("parent_id").alias("above")))
    state = saved(up.select(F.col("id").alias("cycle"), F.col("id").alias("at"), F.array("id").alias("path")))
    closed = None
    while not state.isEmpty():
        step = saved(state.join(up, F.col("at") == F.col("id")).filter(F.col("above") >= F.col("cycle")).select("cycle", F.col("above").alias("at"), F.array_append("path", F.col("above")).alias("path")))
        ends = step.filter("at = cycle")
        closed = ends if closed is None else closed.unionByName(ends)
        state = step.filter("at <> cycle")
    out = closed if closed is not None else state
    return out.select("cycle", F.reverse("path").alias("path"))


def cut_cycles(graph: DataFrame) -> DataFrame:
    """graph with `cyclic`, and without the edges whose two ends are both on a cycle: these nodes become roots, what hangs under them stays."""
    on = saved(cycle_nodes(graph).withColumn("cyclic", F.lit(True)))
    if on.isEmpty():
        return graph.withColumn("cyclic", F.lit(False))
    rows = graph.join(on, "id", "left").join(on.toDF("parent_id", "_above"), "parent_id", "left")
    rows = rows.withColumn("parent_id", F.when(F.col("cyclic") & F.col("_above"), F.lit(None)).otherwise(F.col("parent_id")))
    return rows.withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).select(*graph.columns, "cyclic")


def forest(graph: DataFrame) -> DataFrame:
    """graph (id, parent_id) with root, depth and `cyclic`; a node on a cycle is a root."""
    graph = saved(cut_cycles(graph))
    walked = climb(graph, ["id"], "parent_id", {}, {}).select("id", "root", "depth")
    return graph.join(walked, "id")


def waterfall(graph: DataFrame, scope: str | None = None) -> DataFrame:
    """Concrete nodes with their depth, virtual ancestors not counted, and their order among siblings, or among the scope's roots."""
    graph = saved(cut_cycles(graph))
    own = F.when(F.col("virtual"), 0).otherwise(1)
    walked = climb(graph, ["id"], "parent_id", {"real": own}, {"real": lambda mine, above, _: mine + above})
    rows = graph.join(walked.select("id", (F.col("real") - 1).alias("depth")), "id").filter(~F.col("virtual"))
    rows = rows.withColumn("parent_id", F.when(~F.col("parent_id").startswith("virtual:"), F.col("parent_id")))
    order = Window.partitionBy("parent_id", *([scope] if scope else [])).orderBy("start_ms", "id")
    return rows.withColumn("place", F.row_number().over(order)).select("id", "parent_id", "depth", "place")


def attach_errors(spans: DataFrame, ops: DataFrame) -> DataFrame:
    """spans (id, ...) with the message of their failed operation, if any."""
    failed = ops.filter("status = 'error' AND error_message IS NOT NULL").select(F.col("op_key").alias("id"), "error_message")
    return spans.join(failed, "id", "left")


def sequential_links(ops: DataFrame, scope: str, most_ms: float = 5.0) -> DataFrame:
    """(source, target): neighbours by start whose gap is 0 to most_ms; an operation without an end ends as it starts."""
    by = Window.partitionBy(scope).orderBy("start_ms", "seq")
    before = F.lag(F.struct(F.col("op_key").alias("k"), F.coalesce("end_ms", "start_ms").alias("e"))).over(by)
    rows = ops.withColumn("before", before).withColumn("gap", F.col("start_ms") - F.col("before.e"))
    return rows.filter((F.col("gap") >= 0) & (F.col("gap") <= most_ms)).select(F.col("before.k").alias("source"), F.col("op_key").alias("target"))


def dependencies(edges: DataFrame, sequential: DataFrame) -> DataFrame:
    """(source, target, type): edges from concrete parents, and sequential links."""
    direct = edges.filter(~F.col("parent_id").startswith("virtual:")).select(F.col("parent_id").alias("source"), F.col("child_id").alias("target"), F.lit("parent-child").alias("type"))
    return direct.unionByName(sequential.select("source", "target", F.lit("sequential").alias("type")))

"""Walks towards the root, sums over subtrees and places in the flattened tree, by pointer doubling: a round per power of two of the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import forget, saved


def climb(nodes: DataFrame, key: list[str], parent: str, start: dict[str, Column], combine: dict) -> DataFrame:
    """nodes with their root, depth and combined values over the path to it, and `loop`.

    Nodes on or under a cycle get a null root, and in `loop` a node that is on the cycle; every node of
    a cycle is named by some node. key: the columns that identify a node, the last of them replaced by
    `parent` for the node above (null at roots; a parent that is no node makes a root). start: a value
    per node; combine[name](mine, above, hops): the value over a path from that over its lower and
    upper part, with the number of steps of the lower part.
    """
    scope, own = key[:-1], key[-1]
    nodes = saved(nodes.select(*key, F.col(parent).alias("_want"), *(c.alias(f"_start_{n}") for n, c in start.items())))
    ids = nodes.select(*scope, F.col(own).alias("_want"), F.lit(True).alias("_there"))
    state = nodes.join(ids, [*scope, "_want"], "left").select(
        *key, F.when(F.col("_there"), F.col("_want")).alias("_up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth"),
        F.when(F.col("_there"), F.col("_want")).otherwise(F.col(own)).alias("root"), *(F.col(f"_start_{n}").alias(n) for n in start),
    )
    state = saved(state)
    reach, total = 1, nodes.count()
    done = state.filter("_up IS NULL")
    rest = state.filter("_up IS NOT NULL")
    while reach <= total and not rest.isEmpty():
        # Rows that have arrived leave the loop; the rest looks up where the node above stands.
        above = done.unionByName(rest).select(*scope, F.col(own).alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"), F.col("root").alias("_root"), *(F.col(n).alias(f"_{n}") for n in start))
        state = saved(
            rest.join(above, [*scope, "_up"]).select(
                *key, F.col("_next").alias("_up"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_root").alias("root"),
                *(combine[n](F.col(n), F.col(f"_{n}"), F.col("depth")).alias(n) for n in start),
            )
        )
        done = done.unionByName(state.filter("_up IS NULL"))
        rest = state.filter("_up IS NOT NULL")
        reach *= 2
    return done.unionByName(rest).withColumn("root", F.when(F.col("_up").isNull(), F.col("root"))).withColumnRenamed("_up", "loop")


def _doubled(state: DataFrame, scope: list[str], own: str, names: list[str]) -> DataFrame:
    """Rows that know their subtree up to a distance below and the node that far above -> the same at twice the distance."""
    moved = state.filter("_up IS NOT NULL")
    gained = moved.groupBy(*scope, F.col("_up").alias(own)).agg(*(F.sum(n).alias(f"_{n}") for n in names))
    above = state.select(*scope, F.col(own).alias("_up"), F.col("_up").alias("_next"), F.col("_least").alias("_lower"))
    out = state.join(above, [*scope, "_up"], "left").join(gained, [*scope, own], "left")
    return saved(out.select(*scope, own, F.col("_next").alias("_up"), F.least("_least", "_lower").alias("_least"), *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names)))


def subtree_sums(nodes: DataFrame, key: list[str], parent: str, names: list[str]) -> DataFrame:
    """(key..., names...): each value summed over a node and all below it; a row per node in each round.

    A node knows the sum down to a distance; those exactly that far below bring it theirs, which doubles the
    distance. key and parent as in climb(). Nodes of a cycle all have the sum of the cycle and what hangs on it.
    Nulls count as 0; key must be unique.
    """
    scope, own = key[:-1], key[-1]
    nodes = saved(nodes.select(*key, F.col(parent).alias("_want"), *(F.coalesce(n, F.lit(0)).alias(n) for n in names)))
    there = nodes.select(*scope, F.col(own).alias("_want"), F.lit(True).alias("_there"))
    first = saved(nodes.join(there, [*scope, "_want"], "left").select(*scope, own, F.when(F.col("_there"), F.col("_want")).alias("_up"), F.col(own).alias("_least"), *names))
    state, reach, total = first, 1, nodes.count()
    while reach <= total and not state.filter("_up IS NOT NULL").isEmpty():
        state, before = _doubled(state, scope, own, names), state
        reach *= 2
        if before is not first:
            forget(before)
    if reach <= total or state.filter("_up IS NOT NULL").isEmpty():
        return state.select(*key, *names)
    # What never arrives ends on a cycle; a cycle is known by its least node and summed up as one.
    ends = state.filter("_up IS NOT NULL").select(*scope, F.col("_up").alias(own)).distinct()
    rings = saved(state.join(ends, key).select(*key, F.col("_least").alias("_ring")))
    above = rings.select(*scope, F.col(own).alias("_up"), F.col("_ring").alias("_ring_above"))
    flat = first.join(rings, key, "left").join(above, [*scope, "_up"], "left")
    flat = flat.select(*scope, F.coalesce("_ring", own).alias(own), F.when(F.col("_ring").isNull(), F.coalesce("_ring_above", "_up")).alias("_want"), *names)
    flat = flat.groupBy(*key).agg(F.max("_want").alias("_want"), *(F.sum(n).alias(n) for n in names))
    sums = subtree_sums(flat, key, "_want", names).withColumnRenamed(own, "_named")
    return first.select(*key).join(rings, key, "left").withColumn("_named", F.coalesce("_ring", own)).join(sums, [*scope, "_named"]).select(*key, *names)


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, named: str, whole: str | None = None) -> DataFrame:
    """rows with the sum of `value` over the rows of the same group before each, in an order that has no ties; as `whole` that of the group.

    Rows are cut into ranges of equal size, each is summed on its own and one row a range and group carries
    the sums on: a group with a third of all rows is many tasks. Null groups are left out.
    """
    count = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = saved(rows.repartitionByRange(count, *by, *order).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    carried = (carried.withColumn(whole, F.sum("_sum").over(Window.partitionBy(*by))) if whole else carried).drop("_sum")
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return cut.withColumn("_own", own).join(carried, [*by, "_block"]).withColumn(named, F.col("_own") + F.col("_carried")).drop("_own", "_carried", "_block")


def preorder(nodes: DataFrame, key: list[str], parent: str, order: list[str]) -> DataFrame:
    """(key..., place, depth, size): the place of a node, from 0 in each scope, when its forest is written out node by node, children below.

    Siblings, and the roots of a scope, go by `order` and then the key. Subtree sizes by subtree_sums(), those
    of earlier siblings by running_sum(), then one climb() adds them up along the path. Nodes on or under a
    cycle have no place and are left out.
    """
    scope, own = key[:-1], key[-1]
    nodes = saved(nodes.select(*dict.fromkeys([*key, *order]), F.col(parent).alias("_want"), F.lit(1).cast("long").alias("_size")))
    sizes = saved(subtree_sums(nodes, key, "_want", ["_size"]))
    there = nodes.select(*scope, F.col(own).alias("_want"), F.lit(True).alias("_there"))
    family = F.when(F.col("_there"), F.concat(F.lit("under "), F.col("_want").cast("string"))).otherwise("top")
    rows = nodes.drop("_size").join(there, [*scope, "_want"], "left").join(sizes, key).withColumn("_family", family)
    rows = running_sum(rows, [*scope, "_family"], list(dict.fromkeys([*order, own])), "_size", "_before")
    rows = saved(rows.withColumn("_step", F.col("_before") + F.when(F.col("_there"), 1).otherwise(0)))
    walked = climb(rows, key, "_want", {"place": F.col("_step")}, {"place": lambda mine, above, _: mine + above})
    return walked.filter("root IS NOT NULL").select(*key, "place", "depth").join(sizes.withColumnRenamed("_size", "size"), key)

"""Connected components by contraction: hook to the smallest neighbour, jump to the root, relabel, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _rooted(hook: DataFrame) -> DataFrame:
    """hook (u, p) with p <= u followed until p is its own parent: each join doubles the steps taken."""
    while True:
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = saved(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.coalesce(F.col("pp") < F.col("p"), F.lit(False)).alias("moved")))
        forget(hook.sparkSession, hook)
        if step.filter("moved").isEmpty():
            return step
        hook = step


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (id, component), the smallest id reachable; ids without links are absent.

    Each round every id hooks to its smallest neighbour if that is smaller than itself, the trees so
    made are contracted to their roots, and the links between what is left are made distinct. An id
    that did not hook and to which none hooked has, after the round, only neighbours in trees with
    smaller roots, so it hooks in the next: two rounds at least halve the ids, whatever their order,
    and a round takes as many joins as the logarithm of its deepest tree. Rounds are written to the
    shared checkpoint folder and removed when the next has been; nothing comes to the driver.
    """
    spark = links.sparkSession
    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while True:
        low = links.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p"))
        ids = links.select(F.col("a").alias("u")).union(links.select("b")).distinct()
        hook = _rooted(saved(ids.join(low, "u", "left").select("u", F.coalesce("p", "u").alias("p"))))
        before = labels
        if before is None:
            labels = saved(hook.select(F.col("u").alias("id"), F.col("p").alias("component")))
        else:
            step = hook.select(F.col("u").alias("component"), F.col("p").alias("next"))
            labels = saved(before.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        a = hook.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        b = hook.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        left = links.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = saved(left.filter("a < b").distinct())
        forget(spark, links, hook, before)
        links = left
        if links.isEmpty():
            forget(spark, links)
            return labels

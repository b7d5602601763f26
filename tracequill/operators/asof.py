"""As-of joins: for each row the last one of another table at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import saved


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], named: str) -> DataFrame:
    """left with `named`: a struct of `values` of the last row of right with equal `by` whose `on` is not greater; null where there is none.

    Both tables are put into one order and cut into ranges of equal size, so a key with a third of all rows
    is many tasks. The last row of right is carried forward inside a range; for the keys that cross a border,
    one row a range and key carries it over. Rows come out once each; nothing is multiplied. Of rows of right
    that are equal in `by` and `on` the greatest `values` count. Null keys find nothing.
    """
    count = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*by, on]
    given = F.struct(*left.columns)
    own = left.select(*order, F.lit(1).alias("_side"), given.alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    other = right.dropna(subset=order).select(*order, F.lit(0).alias("_side"), F.lit(None).cast(left.select(given).schema[0].dataType).alias("_row"), F.struct(*values).alias("_value"))
    rows = saved(own.unionByName(other).repartitionByRange(count, *order, "_side").withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block", *by).orderBy(on, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_value", True).over(inside))

    ends = rows.groupBy(*by, "_block").agg(F.max(F.when(F.col("_side") == 0, F.struct(on, "_value"))).alias("_end"))
    spread = ends.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(spread, by, "left_semi").withColumn("_carried", F.last("_end", True).over(before)).select(*by, "_block", F.col("_carried._value").alias("_carried"))
    out = found.filter("_side = 1").join(carried, [*by, "_block"], "left")
    return out.select("_row.*", F.coalesce("_found", "_carried").alias(named))

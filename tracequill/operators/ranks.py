"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import saved
from .trees import running_sum


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., a column per share): nearest-rank percentiles of the non-null values, as percentile_disc gives.

    Equal values are counted, the counts summed up in ranges of the values, and the value picked in whose
    count the rank lies: no group is held by one task. Null groups are left out.
    """
    counts = saved(rows.dropna(subset=[*by, value]).groupBy(*by, value).agg(F.count("*").alias("_n")))
    ran = running_sum(counts, by, [value], "_n", "_before", "_all")
    found = (F.min(F.when(F.col("_before") + F.col("_n") >= F.lit(p) * F.col("_all"), F.col(value))).alias(name) for name, p in shares.items())
    return ran.groupBy(*by).agg(*found)

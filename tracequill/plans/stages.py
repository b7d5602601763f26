"""Cutting lineage for iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in a local session without one, a folder under its warehouse."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/.checkpoints"


def saved(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read again: plan, constraints and lineage are cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tq_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes the tables behind saved frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_tq_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

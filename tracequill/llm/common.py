"""Plan helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of every column the operators add for their own use.
OWN = "__tq_"


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: how far hash space is cut up."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; in a local session without one, a folder under its warehouse."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/.checkpoints"


def saved(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared checkpoint folder and read again: lineage, plan and constraints are cut."""
    path = f"{checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tq_path = path
    return out


def forget(spark: SparkSession, *paths: str | DataFrame | None) -> None:
    """Removes written tables (paths, or what saved() returned) that nothing reads any more."""
    for path in paths:
        path = getattr(path, "_tq_path", None) if isinstance(path, DataFrame) else path
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Gives what a worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """A full collection in the executors: what heaps grew by in one stage is the system's again before the next one's workers need it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def tidy(step):
    """step, a function from batches to batches, which releases memory when a task ends: workers stay."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            release()

    return run


def tidy_group(step):
    """The same for a function of one or two grouped tables."""

    def one(table):
        try:
            return step(table)
        finally:
            release()

    def two(left, right):
        try:
            return step(left, right)
        finally:
            release()

    return one if step.__code__.co_argcount == 1 else two


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a hash of the text, which with the id tells rows that share an id apart."""
    return docs.withColumn(OWN + "th", F.hash(F.col(text_col)))


def with_fields(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """schema without the columns so named, then the new ones."""
    names = {n for n, _ in fields}
    new = T.StructType([f for f in schema.fields if f.name not in names])
    for name, kind in fields:
        new = new.add(name, T._parse_datatype_string(kind))
    return new


def slices(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """parts + 1 offsets that cut sorted 64-bit keys into equal ranges of hash space."""
    edges = [(i << 64) // parts for i in range(1, parts)]
    cut = np.searchsorted(sorted_keys, np.array(edges, dtype=np.uint64)) if edges else np.zeros(0, np.int64)
    return np.concatenate([[0], cut, [len(sorted_keys)]]).astype(np.int64)


def groups_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def int_lists(values: np.ndarray, lengths: np.ndarray, kind=pa.int32()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64), kind))

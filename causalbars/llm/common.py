"""What the operators share: the cluster's shared folder, written tables, file access from executors."""

from __future__ import annotations

import contextlib
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.sources.stored import _CLEANUP, new_dir, shared_dir, unshuffled  # noqa: F401


_SCRATCH: list[list[str]] = []


def written(spark: SparkSession, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and any executor may be lost.

    Its shuffle files go when the table is written. Within ``scratch`` the table goes when that ends, unless it is kept."""
    path = new_dir(spark, name)
    with unshuffled(spark):
        df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that are written within, when their readers are done: only kept ones outlive it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds the Arrow batches sent to Python, so that long texts cannot fill a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Bytes of a table that may be broadcast, as ``row_bytes`` counts them.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), f"`{f.name}`"
        size = size + F.expr(f"coalesce(octet_length({c}), 0) + 16" if kind in ("string", "binary") else f"8 * coalesce(size({c}), 0) + 24" if kind.startswith("array") else "16")
    return size


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of scalars and arrays of numbers, to be broadcast if its counted bytes are few."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES else df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames holds."""
    held = {c.lower() for f in frames for c in f.columns}
    while name.lower() in held:
        name += "_"
    return name


def by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``keys(doc_id, text_hash, ...)`` by id (null is null's equal) and xxhash64 of the text: its
    columns and those of ``keys`` after the hash, which must have other names.

    The keys' bytes are counted first: few are broadcast, so that no text moves, and more are joined by a shuffle.
    """
    own_id, own_hash = fresh("_id", docs, keys), fresh("_hash", docs, keys)
    keys = small(written(docs.sparkSession, keys.withColumnsRenamed({"doc_id": own_id, "text_hash": own_hash}), "keys"))
    text_hash = F.xxhash64(F.col("text").cast("string"))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_hash == F.col(own_hash)), how).drop(own_id, own_hash)


def lean(run):
    """A function for ``mapInArrow`` or ``applyInArrow`` that gives its task's memory back to the system when it ends:
    workers are kept between tasks and stages, whose peaks would otherwise add up."""

    @functools.wraps(run)
    def lean_run(*args):
        yield from run(*args)
        released()

    return lean_run


def released() -> None:
    """Gives memory that is not in use back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(file system, path) of a URI, for tasks: local files, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")

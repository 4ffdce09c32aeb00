"""Helpers shared by the corpus operators: scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share, with its file system.

    Where the session has none, a local session (tests) gets a folder of its own; on a cluster that is an error, for executors share no local folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of so many rows and 8 MB at most, unless the session has settings of its own: long texts make large batches."""
    for key, usual, small in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, small)


#: Caches of Python workers by name. Workers outlive a stage and serve the next one, whose memory must not hold the last one's words.
CACHES: dict[str, dict] = {}


def only(name: str = "") -> None:
    """Empties all caches of this worker but one and gives their memory back to the system."""
    full = [cache for k, cache in CACHES.items() if k != name and cache]
    for cache in full:
        cache.clear()
    if full:
        trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow frees what its batches took into a pool of its own
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if give:
        give(0)


def release(spark: SparkSession) -> None:
    """Empties the caches of Python workers that wait for tasks: before stages of the JVM alone, which would stand beside them. Each worker gets its turn, so a few short tasks a core reach them."""

    def empty(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        yield from parts

    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInPandas(empty, "id long").write.format("noop").mode("overwrite").save()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is run within are deleted as soon as it has run: nothing reads them again. The session's setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def relieve(spark: SparkSession) -> None:
    """Lets the driver go of ended queries' plans and broadcast tables once its heap has grown past half its limit.

    It would else keep them until the heap is full, and around a heap a JVM takes most of that again for threads, code and buffers.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        gc.collect()  # what Python refers to, the JVM can't free
        spark._jvm.java.lang.System.gc()


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This cuts the lineage: a lost executor repeats only what follows. A saved aggregate is also a plain scan for the
    next join, so that adaptive execution can split a skewed partition of it, which it can't do above an aggregate.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    relieve(spark)
    held = spark.read.schema(df.schema).parquet(path)
    held._scratch = path
    return held


def drop(*saved: DataFrame) -> None:
    """Deletes tables of save() of which nothing will be read again."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) by alternating large-star and small-star rounds.

    Returns (id, component): every id that has an edge to another id, with the smallest id it can reach. All work is
    joins and minima over edges; nothing is gathered on the driver but one checksum a round. Rows with nulls and loops
    are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = save(e.where("u <> v").distinct(), name)
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (now.n, now.x) or not now.n:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = (now.n, now.x)
        last, both = e, e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = save(both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(last, nearest, large, least)
    raise RuntimeError(f"{name}: no fixed point after {max_rounds} rounds")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))

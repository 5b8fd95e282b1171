"""What several operators share: tables, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; an own one only where that is unset and driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext.getCheckpointDir()
        if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = at or tempfile.mkdtemp(prefix="rubrica-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rubrica-{name}-{uuid.uuid4().hex}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it (columns would be inlined into lambdas and computed for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what is made of one batch's texts is held at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Bytes of an Arrow batch between the JVM and a Python worker; both sides hold a few of them for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of BATCH_BYTES, unless the session sets another size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


_held: dict[str, Callable[[], None]] = {}


def holding(name: str, forget: Callable[[], None]) -> None:
    """In a Python worker: what an operator keeps stays for its next task, until another operator's comes."""
    release(name)
    if name not in _held:
        _trim()  # of what tasks that kept nothing have freed
    if name in _held and _held[name] != forget:
        _held[name]()
    _held[name] = forget


def release(but: str | None = None) -> None:
    """In a Python worker: what operators other than this one keep goes, and its memory back to the machine."""
    gone = [_held.pop(n) for n in list(_held) if n != but]
    for forget in gone:
        forget()
    if gone:
        _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Frees the shuffle files and cuts of steps that are over: Spark drops them when its driver's garbage collector finds nobody holds them, which by itself may take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps; each step is one aggregation and one join over the
    edges, and the edges only shrink. A hub's rows meet one label row, so a skewed join splits them.
    Nodes without an edge to another node are not returned.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # each node's neighbours that are smaller, and the node itself, now hang on the least of them
        star = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(star.select("e.a", "e.b").where("a <> b").distinct())
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if was == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Helpers that the operators of this subpackage share: reading tables, cutting lineage, word patterns, components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch handed to Python, so that very long texts do not pile up in a worker.
BATCH_ROWS = 500
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch; never raises a smaller bound that the session already has.

    Spark reads both settings when a plan runs, not when it is made, so they stay set for the session; they change the
    size of batches only, never a result.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    found = re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", setting.strip().lower())
    return int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def give_back() -> None:
    """Return memory that Python has freed to the system (glibc keeps it otherwise); elsewhere nothing happens."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(results: Iterator, every: int = 16) -> Iterator:
    """The results of a worker's batches, with freed memory returned now and then and at the end.

    Workers are kept for the stages that follow, so what one stage has freed would count against them.
    """
    try:
        for k, result in enumerate(results, 1):
            yield result
            if k % every == 0:
                give_back()
    finally:
        give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or os.path.dirname(sc.getCheckpointDir())


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder; lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of edges (a, b: long): one row (id, component) per vertex, component its smallest vertex.

    Large-star and small-star rounds (Kiveris et al. 2014) expressed as aggregates, a join and a window, five shuffles each,
    so no neighbour list is ever gathered; each round is cut from its lineage. The number of rounds grows with the
    logarithm of the vertices. Self-loops and repeated edges are harmless; an empty input gives an empty result; rows with a
    null end are ignored. Raises RuntimeError rather than return an unfinished result.
    """
    ends = [F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")]
    links = cut(edges.where("a is not null and b is not null and a <> b").select(*ends).distinct())
    for _ in range(max_rounds):
        # Large-star: every larger neighbour of a vertex is tied to the vertex's smallest neighbour (or the vertex). The key is
        # complemented so that the aggregate is shuffled again: Spark splits a join only where both sides were shuffled for it.
        both = links.select(F.col("v").alias("u"), F.col("m").alias("low")).unionAll(links.select(F.col("m").alias("u"), F.col("v").alias("low")))
        low = both.groupBy("u").agg(F.min("low").alias("low")).select(F.bitwise_not("u").alias("key"), F.least("u", "low").alias("low"))
        large = links.select("v", "m", F.bitwise_not("m").alias("key")).join(low, "key")
        large = large.select("v", F.col("low").alias("m"), (F.col("low") < F.col("m")).alias("moved"))
        # Small-star: the smaller neighbours of a vertex, and the vertex, are tied to the smallest of them.
        small = large.withColumn("low", F.min("m").over(Window.partitionBy("v")))
        more = F.col("low") < F.col("m")
        own = F.struct("v", F.col("low").alias("m"), (F.col("moved") | more).alias("moved"))
        other = F.struct(F.col("m").alias("v"), F.col("low").alias("m"), F.lit(True).alias("moved"))
        small = small.select(F.explode(F.when(more, F.array(own, other)).otherwise(F.array(own))).alias("x")).select("x.*")
        links = cut(small.groupBy("v", "m").agg(F.max("moved").alias("moved")))
        if links.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("m").alias("id")).distinct()
    return links.select(F.col("v").alias("id"), F.col("m").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))

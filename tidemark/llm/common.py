"""What the operators of this subpackage share: table reads, checkpoints, Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row in four of the labelled tables is never learnt from: crc32(id as text) mod 4 equals this.
HELD_OUT = 2
ARROW_BYTES, _BATCHES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """A null id counts as the empty text, so that the flag is never null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def free_name(df: DataFrame, base: str, *taken: str) -> str:
    """A name for a column of the operator's own that no column of df has, whatever the case of its letters."""
    used, name = {c.lower() for c in (*df.columns, *taken)}, base
    while name in used:
        name = f"_{name}"
    return name


def row_key(id_col: str = "id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def settle(df: DataFrame) -> DataFrame:
    """Compute df once, in the folder that spark.checkpoint.dir names, and cut its lineage there.

    Executors share that folder, so the copy outlives any of them. Where the setting is missing, a temporary folder takes its
    place on a local master, as in tests; on a cluster executors would not share one, so that is an error. From here on Arrow batches hold ARROW_BYTES at most, as Python workers share an
    executor's memory with its heap.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    conf.set(_BATCHES, str(ARROW_BYTES))
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referred to, such as those before a settled one.

    Spark does so whenever the driver collects its garbage, which for a driver with little to do is rare.
    """
    for _ in range(2):  # first the frames, then what they alone referred to
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # files go in the background; what follows would stand beside them


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it


def give_back() -> None:
    """Return to the system what a Python worker has freed: workers are kept for later tasks, and share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text each, or one row."""
    n, start, held = batch.num_rows, 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i in range(n):
        if held and held + sizes[i] > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += sizes[i]
    if start < n:
        yield batch.slice(start)
    give_back()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs to (node, component): the smallest node that can be reached, for nodes with an edge.

    Each round points every node at its first neighbour in the order of a hash, if that is before itself, follows the
    pointers, and replaces the nodes by what they point at. The order is random, so chains of pointers are short even along
    a sorted path, and the graph shrinks to nothing in a logarithmic number of rounds. The joins are by sorting and nothing
    is gathered; the driver learns once a round whether edges are left.
    """
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    first = lambda x, y: F.when(order(y) < order(x), F.col(y)).otherwise(F.col(x))
    left = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        to = left.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("near")).select("a", first("a", "near").alias("into"))
        for _ in range(2):
            step = to.select(F.col("a").alias("via"), F.col("into").alias("beyond"))
            to = to.join(step.hint("merge"), F.col("into") == F.col("via")).select("a", F.col("beyond").alias("into"))
        to = settle(to)
        other = to.select(F.col("a").alias("b"), F.col("into").alias("into_b"))
        left = settle(left.join(to.hint("merge"), "a").join(other.hint("merge"), "b").select(F.col("into").alias("a"), F.col("into_b").alias("b")).filter("a <> b").distinct())
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("into").alias("component"))
        else:
            labels = labels.join(to.hint("merge"), F.col("component") == F.col("a"), "left").select("node", F.coalesce("into", "component").alias("component"))
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least.hint("merge"), "component").select("node", F.col("least").alias("component"))

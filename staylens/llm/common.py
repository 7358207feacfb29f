"""Helpers that several operators share: checkpoints, connected components and Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: where the innermost ``scratch`` notes the tables that it will remove
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and return what stands there, so its lineage is cut.

    The folder is the session's ``spark.checkpoint.dir``; a folder of this machine is used only where
    that setting is absent and Spark runs on this machine alone, as in local tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    # small row groups: a writer holds one in memory
    df.write.option("compression", "snappy").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables checkpointed inside are removed at the end, so no plan that reads them may leave; gives the function that checkpoints what stays."""
    outer, passing = _PASSING.get(), []
    token = _PASSING.set(passing)

    def lasting(df: DataFrame) -> DataFrame:
        inner = _PASSING.set(outer)
        try:
            return checkpointed(df)
        finally:
            _PASSING.reset(inner)

    try:
        yield lasting
    finally:
        _PASSING.reset(token)
        for path in passing:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def prepared(spark: SparkSession) -> None:
    """Put this checkout on the path of Python workers wherever the driver was started; they take Arrow's memory from the C library, which gives it back when a task ends."""
    root, settings = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in settings.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        settings["PYTHONPATH"] = os.pathsep.join([root, *paths])
    settings.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    settings.setdefault("MALLOC_ARENA_MAX", "2")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What runs inside hands whole texts to Python by at most ``rows``: both sides hold a batch, and Spark's side grows it by doubling."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Component of every node of ``edges`` (a long, b long): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps until no edge changes. Each step is a map-side-combined
    minimum by node and a join, so a hub's edges are never gathered in one task; only the number of
    changed edges reaches the driver. An empty input gives no rows.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    current = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(max_rounds):
        neighbours = both_ways(current)
        lowest = neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = neighbours.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge of `large` points from the greater to the smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        current = checkpointed(small)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fresh(taken: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (n + 1); a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets.astype(np.int64) - int(offsets[0])


def portions(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column ``text`` of each holds about ``limit`` bytes, or one row if that is longer."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: what the tasks of a worker keep for each other; tasks that do not need it empty it
CACHES: list[dict] = []


def release(keep: bool = False) -> None:
    """Give memory that this worker no longer needs back to the system; with ``keep`` its caches stay."""
    if not keep:
        for cache in CACHES:
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU C library has it
        pass


def tidy(task: Callable, keep: bool = False) -> Callable:
    """The task over batches, begun and ended with what earlier work left in the worker given back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        try:
            yield from task(batches)
        finally:
            release(keep)

    return run


MARKS = 1 << 24


def mark_of(column: str) -> Column:
    """Slot of a value among the MARKS bits of a filter."""
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def marks(df: DataFrame, column: str) -> np.ndarray:
    """One bit for each slot that a value of the column has, 2 MB whatever the input; built where the rows are."""
    slots = df.select(mark_of(column).alias("slot"))
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    size = 4_096 * 8
    out = np.zeros(MARKS // 8 + 2 * 4_096, np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * size // 8 if r["bucket"] > 0 else len(out) - 4_096
        out[at: at + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is marked. Buckets of Spark's bitmaps begin at 1, after the place 0."""
    place = np.where(slots > 0, slots - 1, 8 * (len(bits) - 4_096))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

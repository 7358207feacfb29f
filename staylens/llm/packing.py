"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt over blocks; for each block several islands evolve packings from random groupings. A
crossover injects whole well-filled bins of one parent into another, drops the bins that hold the same
pieces twice and best-fits what they displace. After each epoch the elite of every island migrates to the
next island of its block. Every block is a row, so Spark spreads blocks x islands over the cluster.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.bpe import encoder
from staylens.llm.common import checkpointed, portions, small_batches, tidy

Packing = list[list[int]]
#: from which share of the capacity a bin is full, and the share of full bins injected
FULL, INJECTED = 0.999, 0.5
#: bounds of the share of the other parent's bins that a crossover empties
EMPTIED = 0.3, 0.7
#: bytes of text that a task encodes at once
PORTION = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _laid(names: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int, end: int) -> pa.RecordBatch:
    """Rows of PIECES: the ids of each document, one after another in ``ids``, with the end id, cut at ``capacity``."""
    lengths = counts + 1
    ends = np.cumsum(lengths)
    flat = np.full(ends[-1], end, np.uint32)
    own = np.ones(len(flat), bool)
    own[ends - 1] = False
    flat[own] = ids
    pieces = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(capacity, lengths[row] - start)
    offsets = np.concatenate(([0], np.cumsum(4 * length))).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), cut], ["doc_id", "piece", "start", "length", "ids"])


def _cut(path: str, capacity: int, end: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in portions(batches, 1, PORTION):
            texts = batch.column(1).fill_null("")
            # only texts that may hold special tokens' strings are cut one by one
            odd = pc.match_substring(texts, "<|")
            for kind in (pc.invert(odd), odd):
                some, names = texts.filter(kind), batch.column(0).filter(kind)
                if not len(some):
                    continue
                if kind is odd:
                    coded = own.encode_many(some.to_pylist())
                    ids, counts = np.frombuffer(b"".join(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                else:
                    ids, counts = own.encode_column(some)
                yield _laid(names, ids, counts, capacity, end)

    return cut


def token_pieces(docs: DataFrame, path: str, capacity: int = 2_048, end: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each document's ids and the id ``end``, cut at ``capacity``.

    A null text counts as empty: one piece that holds the end id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_cut(path, capacity, end), keep=True), PIECES)


def best_fit(bins: Packing, room: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put items, in order, each into the fullest bin that still takes it; opens bins as needed."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = r - size
        if room[b]:
            insort(free, (room[b], b))


def _packed(items: list[int], sizes: list[int], capacity: int) -> Packing:
    bins: Packing = []
    best_fit(bins, [], items, sizes, capacity)
    return bins


def fitness(bins: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals the more unevenly filled."""
    return -len(bins), sum((sum(map(sizes.__getitem__, b)) / capacity) ** 2 for b in bins)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject full bins of ``b`` into ``a``, drop bins with duplicates and the emptiest others, best-fit what was displaced."""
    def fill(x: list[int]) -> int:
        return sum(map(sizes.__getitem__, x))

    fills = sorted(((fill(x), k) for k, x in enumerate(b)), reverse=True)
    wells = [k for f, k in fills if f >= FULL * capacity] or [k for _, k in fills[: max(1, len(fills) // 4)]]
    first = rng.randrange(len(wells))
    chosen = [b[k] for k in (wells + wells)[first: first + max(1, int(len(wells) * INJECTED))]]
    held = {i for x in chosen for i in x}
    kept = sorted((x for x in a if held.isdisjoint(x)), key=fill)
    bins = [list(x) for x in kept[max(1, int(len(kept) * rng.uniform(*EMPTIED))):] + chosen]
    there = {i for x in bins for i in x}
    out = sorted((i for x in a for i in x if i not in there), key=lambda i: (-sizes[i], i))
    best_fit(bins, [capacity - fill(x) for x in bins], out, sizes, capacity)
    return bins


def evolve(sizes: list[int], capacity: int, seeds: list[Packing], rng: random.Random, population: int, generations: int) -> tuple[Packing, list[int], int]:
    """The best packing an island finds, the fewest bins before and after each crossover, and how many crossovers here led to the best.

    The pool begins with the elites that the island was sent and random groupings (pieces in random order, each into the fullest bin that
    takes it); all else are crossovers. An island that was sent no elite makes at least one; beyond that it ends once no packing can
    have fewer bins. The best of the pool always stays, so an island never gives up what it was sent.
    """
    def rated(bins: Packing, born: int) -> tuple[tuple[int, float], Packing, int]:
        return fitness(bins, sizes, capacity), bins, born

    if not sizes:  # a block of full pieces alone
        return [], [0], 0
    floor = -(-sum(sizes) // capacity)
    order = list(range(len(sizes)))
    pool = [rated(p, 0) for p in seeds]
    # beside an elite that no packing can beat nothing needs to be grouped
    while len(pool) < max(2, population) and min(map(len, seeds), default=floor + 1) > floor:
        rng.shuffle(order)
        pool.append(rated(_packed(order, sizes, capacity), 0))
    trail = [min(len(p) for _, p, _ in pool)]
    for _ in range(generations):
        if trail[-1] <= floor and (seeds or len(trail) > 1):
            break
        pool.sort(key=lambda x: x[0], reverse=True)
        (_, a, born_a), (_, b, born_b) = pool[0], pool[rng.randrange(1, len(pool))]
        child = crossover(a, b, sizes, capacity, rng)
        pool = [*pool[: max(1, population - 1)], rated(child, 1 + max(born_a, born_b))]
        trail.append(min(trail[-1], len(child)))
    _, best, born = max(pool, key=lambda x: x[0])
    return best, trail, born


def _numbers(bins: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, x in enumerate(bins):
        for i in x:
            out[i] = k
    return out


def _bins(numbers: list[int]) -> Packing:
    bins: Packing = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins


def _island(capacity: int, seed: int, population: int, generations: int) -> Callable:
    def island(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for block, isle, epoch, sizes, elites in zip(frame["block"], frame["island"], frame["epoch"], frame["sizes"], frame["elites"], strict=True):
                sizes = [int(x) for x in sizes]
                rng = random.Random(f"{seed}:{block}:{isle}:{epoch}")
                best, trail, born = evolve(sizes, capacity, [_bins([int(k) for k in e]) for e in elites], rng, population, generations)
                out.append((block, isle, _numbers(best, len(sizes)), *fitness(best, sizes, capacity), trail, born))
            yield pd.DataFrame(out, columns=["block", "island", "bins", "few", "uneven", "trail", "born"])

    return island


def pack(pieces: DataFrame, capacity: int = 2_048, block_pieces: int = 4_096, islands: int = 2, epochs: int = 2,
         population: int = 4, generations: int = 12, seed: int = 11) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length and any others) with sequence_id and offset.

    Every length is from 1 to ``capacity``; a full piece gets a sequence of its own. offset is the place
    of a piece in its sequence, gapless from 0. Repeated rows are packed as often as they come; doc_id
    may be null; columns named sequence_id and offset are replaced, all others may have any name. An empty
    table gives no rows. A block's pieces are one row of about ``block_pieces`` small numbers, whatever
    the input; nothing reaches the driver but the number of pieces.
    """
    payload = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # the checkpoint fixes the number that spreads repeated rows
    items = checkpointed(pieces.select(F.struct(*payload).alias("item"), F.monotonically_increasing_id().alias("number")))
    blocks = max(1, -(-items.count() // block_pieces))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    blocked = checkpointed(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("item.length").alias("length"), "number", "item"))).alias("items")))
    partial = blocked.select("block", F.filter("items", lambda x: x["length"] < capacity).alias("items"))
    isles = partial.select("block", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    schema = "block long, island int, bins array<int>, few long, uneven double, trail array<int>, born int"
    run = _island(capacity, seed, population, generations)
    spread_rows = max(1, min(blocks * islands, 100_000))
    none = F.array().cast("array<array<int>>")
    elites = checkpointed(isles.withColumn("elites", none).withColumn("epoch", F.lit(0)).repartition(spread_rows, "block", "island")
                          .select("block", "island", "epoch", "sizes", "elites").mapInPandas(run, schema))
    for epoch in range(1, epochs):
        moved = elites.select("block", ((F.col("island") + 1) % islands).alias("island"), "bins").unionByName(elites.select("block", "island", "bins"))
        sent = moved.groupBy("block", "island").agg(F.collect_set("bins").alias("elites"))
        elites = checkpointed(isles.join(sent, ["block", "island"]).withColumn("epoch", F.lit(epoch)).repartition(spread_rows, "block", "island")
                              .select("block", "island", "epoch", "sizes", "elites").mapInPandas(run, schema))
    best = elites.groupBy("block").agg(F.max_by("bins", F.struct("few", "uneven", "island")).alias("bins"))
    placed = blocked.join(best, "block")
    small = F.zip_with(F.filter("items", lambda x: x["length"] < capacity), "bins", lambda x, k: F.struct(k.cast("long").alias("bin"), x.alias("x")))
    full = F.transform(F.filter("items", lambda x: x["length"] == capacity), lambda x, k: F.struct((-1 - k).cast("long").alias("bin"), x.alias("x")))
    laid = placed.select("block", F.explode(F.concat(small, full)).alias("of")).select("block", "of.bin", "of.x.number", "of.x.length", "of.x.item")
    inside = Window.partitionBy("block", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    found = laid.select(
        "item", (F.col("block") * F.lit(1 << 20) + F.col("bin") + F.lit(1 << 19)).alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    return found.select(*[F.col("item").getField(c).alias(c) for c in payload], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2_048, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all documents.

    With ``with_ids`` also ids (binary, little-endian uint32): the ids of a sequence are those of its pieces by
    offset. Null and empty texts are a piece of one end id; other columns are not looked at.
    """
    pieces = token_pieces(docs, path, capacity)
    columns = ["doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")]
    with small_batches(docs.sparkSession):  # the texts are read and encoded in here, by a checkpoint
        if not with_ids:
            return pack(pieces.select(*columns), capacity)
        # ids wait in the checkpoint while the lengths are packed; the number joins them again
        numbered = checkpointed(pieces.withColumn("number", F.monotonically_increasing_id()))
    placed = pack(numbered.select(*columns, "number"), capacity)
    return placed.join(numbered.select("number", "ids"), "number").drop("number")

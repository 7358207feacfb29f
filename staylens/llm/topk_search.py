"""Exact top-k inner-product search with block-at-a-time pruning.

Each dimension counts as two terms, its positive and its negative side. Candidates are dealt over ranges
("areas"), the leaves of a tree that halves a sample by its main direction, so areas are of like size however
the vectors lie; inside an area they are cut into blocks of ``block_rows`` rows. Every area and block keeps the
maximum of each term; the sum of a query's term weights times these maxima bounds every score inside. A query
first visits the area with the highest bound, which gives it a k-th score, then only the areas whose bound
reaches that score; inside an area it takes blocks in descending order of bound, scores them through the
block's forward index (a row matrix), and stops below its k-th score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed

EXACT = 2.0**53
#: bounds of what is broadcast: areas, and numbers in their maxima; a larger input has larger areas, in more parts
MAX_AREAS, MAX_NUMBERS = 4_096, 4_000_000
SAMPLE_ROWS = 65_536
HITS = "qrep long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, v array<long>) with floor(scale * x) in double; rows with a null or non-finite component drop out."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float(2**52))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))
    )


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; doubles while every partial sum is below 2^53, Python integers beyond."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if reach < EXACT:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return (queries.astype(object) @ rows.astype(object).T).astype(np.int64)


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query in each block: term weights times term maxima (float, rounded up)."""
    up = np.maximum(queries, 0).astype(float) @ most.astype(float).T + np.minimum(queries, 0).astype(float) @ least.astype(float).T
    return up + np.abs(up) * 1e-9 + 1


def _rounds(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, cuts: np.ndarray, bound: np.ndarray, floors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and ids of each query: in each round every query takes its next block by bound, until no block can reach its floor."""
    n, width = len(queries), int(np.diff(np.append(cuts, len(ids))).max())
    order = np.argsort(-bound, axis=1, kind="stable")
    least, none = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best, names = np.full((n, depth), least), np.full((n, depth), none)
    ends = np.append(cuts[1:], len(ids))
    going, floors = np.arange(n), floors.copy()
    for turn in range(len(cuts)):
        block = order[going, turn]
        going = going[bound[going, block] >= floors[going]]
        if not len(going):
            break
        block = order[going, turn]
        at = cuts[block][:, None] + np.arange(width)
        sound = at < ends[block][:, None]
        at = np.minimum(at, len(ids) - 1)
        score = np.where(sound, np.einsum("qd,qbd->qb", queries[going], rows[at]).astype(np.int64), least)
        score = np.where(score >= floors[going][:, None], score, least)
        together, known = np.concatenate((best[going], score), 1), np.concatenate((names[going], np.where(score > least, ids[at], none)), 1)
        # scores are above the least integer, so their negation is sound
        first = np.lexsort((known, -np.maximum(together, least + 1)), axis=1)[:, :depth]
        best[going], names[going] = np.take_along_axis(together, first, 1), np.take_along_axis(known, first, 1)
        kth = best[going, depth - 1]
        floors[going] = np.where(kth > least, np.maximum(floors[going], kth.astype(float)), floors[going])
    return best, names


def _search(depth: int, block_rows: int) -> Callable:
    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """All queries of ``left`` against the rows of one part of an area."""
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("qrep", "vec_id", "score")})
        if not len(left) or not len(right):
            return empty
        ids = right["vec_id"].to_numpy(np.int64)
        rows = np.stack(right["v"].to_numpy()).astype(np.int64)
        order = np.lexsort((ids, *rows.T[:4])) if rows.shape[1] else np.argsort(ids)
        ids, rows = ids[order], rows[order]
        cuts = np.arange(0, len(ids), block_rows)
        queries = np.stack(left["v"].to_numpy()).astype(np.int64)
        names, floors = left["qrep"].to_numpy(np.int64), left["floor"].to_numpy(dtype=float, na_value=-np.inf)
        bound = _bounds(queries, np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts))
        reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
        if reach < EXACT:  # every partial sum is exact in double
            best, found = _rounds(queries.astype(float), rows.astype(float), ids, cuts, bound, floors, depth)
            i, j = np.nonzero(best > np.iinfo(np.int64).min)
            return pd.DataFrame({"qrep": names[i], "vec_id": found[i, j], "score": best[i, j]})
        out = []
        for i, name in enumerate(names):
            score = _scores(queries[i: i + 1], rows)[0]
            good = np.flatnonzero(score >= floors[i])
            out += [(name, x, -s) for s, x in sorted(zip((-score[good]).tolist(), ids[good].tolist(), strict=True))[:depth]]
        return pd.DataFrame(out, columns=["qrep", "vec_id", "score"]).astype("int64") if out else empty

    return search


class Areas:
    """A tree over vectors of one length: inner nodes split by a direction and a value, leaves are areas."""

    def __init__(self, sample: np.ndarray, areas: int):
        self.directions: list[np.ndarray] = []
        self.values: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample.astype(float), areas, np.random.default_rng(3))

    def _grow(self, rows: np.ndarray, areas: int, rng: np.random.Generator) -> int:
        """Number of an inner node, or the complement of a leaf's number."""
        direction, value = self._split(rows, rng) if areas > 1 and len(rows) > 1 else (None, 0.0)
        if direction is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.values)
        self.directions.append(direction)
        self.values.append(value)
        self.children.append([0, 0])
        above = rows @ direction > value
        self.children[node] = [self._grow(rows[~above], areas - areas // 2, rng), self._grow(rows[above], areas // 2, rng)]
        return node

    @staticmethod
    def _split(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, float]:
        centred = rows - rows.mean(0)
        direction = rng.normal(size=rows.shape[1])
        for _ in range(8):  # power iteration towards the main direction
            step = centred.T @ (centred @ direction)
            size = np.linalg.norm(step)
            if not size:
                return None, 0.0
            direction = step / size
        along = rows @ direction
        value = float(np.median(along))
        if (along > value).any():
            return direction, value
        below = along[along < value]
        return (direction, float(below.max())) if len(below) else (None, 0.0)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Area of each row; the tree is walked level by level."""
        at = np.full(len(rows), self.root)
        if not self.values:
            return np.zeros(len(rows), np.int64)
        directions, values, children = np.stack(self.directions), np.array(self.values), np.array(self.children)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            at[open_] = children[node, ((rows[open_] * directions[node]).sum(1) > values[node]).astype(int)]
        return ~at


def _placed(trees: dict[int, tuple[int, Areas]]) -> Callable:
    """(vec_id, v, area): areas of lengths that the sample does not hold are numbered below zero."""
    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["v"].map(len).to_numpy()
            area = np.zeros(len(frame), np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                if size in trees and size:
                    first, tree = trees[size]
                    area[own] = first + tree.place(np.stack(frame["v"].to_numpy()[own]).astype(float))
                else:
                    area[own] = -1 - size
            yield frame.assign(area=area)

    return placed


def _extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(area, n, hi, lo) of each batch and area."""
    for frame in frames:
        out = []
        for area, own in frame.groupby("area"):
            rows = np.stack(own["v"].to_numpy()).astype(np.int64)
            out.append((area, len(own), rows.max(0), rows.min(0)))
        yield pd.DataFrame(out, columns=["area", "n", "hi", "lo"])


def _visits(maxima: object, home: bool) -> Callable:
    """(qrep, v, floor, area) of the areas that queries (qrep, v, floor, home) visit: that of the highest bound, or all others that reach the floor."""
    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size = maxima.value
        for frame in frames:
            sizes = frame["v"].map(len).to_numpy()
            taken, areas = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(sizes).tolist():
                if size not in by_size:
                    continue
                names, high, low = by_size[size]
                own = np.flatnonzero(sizes == size)
                bound = _bounds(np.stack(frame["v"].to_numpy()[own]).astype(np.int64), high, low)
                best = bound.argmax(1)
                if home:
                    taken.append(own)
                    areas.append(names[best])
                else:
                    reach = bound >= frame["floor"].to_numpy(dtype=float, na_value=-np.inf)[own][:, None]
                    reach[np.arange(len(own)), best] = False
                    i, j = np.nonzero(reach)
                    taken.append(own[i])
                    areas.append(names[j])
            at = np.concatenate(taken)
            yield frame.iloc[at].assign(area=np.concatenate(areas))

    return visits


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, area_rows: int = 4_096, block_rows: int = 64, query_rows: int = 512) -> DataFrame:
    """The k candidates (vec_id, v) with the highest inner product for each query (vec_id, v): rows (query_id, rank, vec_id, score).

    A query never meets a candidate of its own vec_id or of another length; ties go to the smaller
    vec_id; with fewer than k candidates all are returned. Equal query vectors are searched once, and of
    equal candidates only the k + 1 smallest ids can ever be returned, so copies make no hot group. Both
    sides may be empty. Ids are unique and not null; rows without an id take no part. A task holds one part
    of an area, about ``area_rows`` candidates, and about ``query_rows`` of its queries. The tree is fitted on at
    most 65,536 candidates and only deals rows; it and the areas' term maxima, both of bounded size, are broadcast.
    """
    context = candidates.sparkSession.sparkContext
    queries, candidates = queries.filter("vec_id IS NOT NULL"), candidates.filter("vec_id IS NOT NULL")
    distinct = checkpointed(queries.groupBy("v").agg(F.min("vec_id").alias("qrep")))
    ranked = Window.partitionBy("v").orderBy("vec_id")
    kept = checkpointed(candidates.select("vec_id", "v").withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k + 1).drop("n"))
    total = kept.count()
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE_ROWS, 64 * max(1, total // area_rows + 1))).select("v").toArrow()["v"].to_pylist()
    trees: dict[int, tuple[int, Areas]] = {}
    first = 0
    for size in sorted({len(v) for v in sample} - {0}):
        own = np.array([v for v in sample if len(v) == size], np.int64).reshape(-1, size)
        areas = min(MAX_AREAS, max(1, MAX_NUMBERS // max(1, size)), -(-total * len(own) // (len(sample) * area_rows)))
        trees[size] = first, Areas(own, int(areas))
        first += trees[size][1].leaves
    laid = checkpointed(kept.mapInPandas(_placed(trees), "vec_id long, v array<long>, area long"))
    extremes = laid.mapInPandas(_extremes, "area long, n long, hi array<long>, lo array<long>")
    summed = extremes.select("area", "n", F.posexplode_outer(F.arrays_zip("hi", "lo")).alias("d", "x")).groupBy("area", "d").agg(F.sum("n").alias("n"), F.max("x.hi").alias("hi"), F.min("x.lo").alias("lo"))
    folded = checkpointed(summed.groupBy("area").agg(F.max("n").alias("n"), F.filter(F.array_sort(F.collect_list(F.struct("d", "hi", "lo"))), lambda x: x["d"].isNotNull()).alias("x")).select("area", "n", F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo")))
    by_size: dict[int, list] = {}
    for r in folded.collect():
        by_size.setdefault(len(r["hi"]), []).append((r["area"], r["hi"], r["lo"]))
    maxima = context.broadcast({s: (np.array([x[0] for x in rows], np.int64), *(np.array([x[i] for x in rows], np.int64) for i in (1, 2))) for s, rows in by_size.items()})
    parts = folded.select("area", F.ceil(F.col("n") / area_rows).cast("int").alias("parts"))
    visit = "v array<long>, qrep long, floor double, area long"

    def scored(asked: DataFrame) -> DataFrame:
        asked = checkpointed(asked)
        sizes = asked.groupBy("area").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("chunks")).join(parts, "area")
        left = asked.join(sizes, "area").withColumn("chunk", F.pmod(F.xxhash64("qrep"), F.col("chunks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = laid.join(sizes, "area").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        left = left.select(*[F.col(c).alias(f"to_{c}") for c in ("area", "part", "chunk")], F.col("qrep").alias("qrep"), F.col("v").alias("v"), "floor")
        right = right.select("area", "part", "chunk", "vec_id", "v")
        return left.groupBy("to_area", "to_part", "to_chunk").cogroup(right.groupBy("area", "part", "chunk")).applyInPandas(_search(k + 1, block_rows), HITS)

    best = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id")
    at_home = scored(distinct.withColumn("floor", F.lit(None).cast("double")).mapInPandas(_visits(maxima, True), visit))
    at_home = checkpointed(at_home.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n"))
    floors = at_home.groupBy("qrep").agg(F.when(F.count("*") > k, F.min("score").cast("double")).alias("floor"))
    rest = distinct.join(floors, "qrep", "left").select("v", "qrep", "floor").mapInPandas(_visits(maxima, False), visit)
    hits = at_home.unionByName(scored(rest))
    hits = hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    named = queries.select(F.col("vec_id").alias("query_id"), "v").join(distinct, "v").select("query_id", "qrep")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.join(hits, "qrep").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

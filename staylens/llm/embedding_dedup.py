"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table lookups, exact rerank.

A vector is filed under the nearest coarse centroid with a product-quantised residual and the length of
what the code leaves out. A query probes every list whose cell can hold a vector within the cosine
threshold (the bisecting plane of the two centroids lies within the threshold's chord of the query), so
the probes are sufficient. In a list, asymmetric distances are sums of table entries; the stored
remainder bounds their error, so no link is lost. Survivors are checked by exact cosine in double.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed, connected_components

SUBSPACES, CODES = 8, 16
SAMPLE_ROWS = 8_192
TILE = 256


def _kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def train(sample: np.ndarray, lists: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids [lists, dim] and residual codebooks [SUBSPACES, CODES, sub] from unit vectors."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(sample, lists, 8, rng)
    rest = sample - coarse[((coarse**2).sum(1) - 2 * sample @ coarse.T).argmin(1)]
    books = []
    for part in np.split(rest, SUBSPACES, axis=1):
        book = _kmeans(part, CODES, 8, rng)
        books.append(np.pad(book, ((0, CODES - len(book)), (0, 0)), mode="edge"))
    return coarse, np.stack(books)


def _padded(column: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at] = flat
    return out


def _file(model: tuple, width: int, reach: float) -> Callable:
    """A row for the list that a vector is filed under (code set) and for each list it probes (code null)."""
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = model
        gaps = np.sqrt(((coarse[:, None] - coarse[None]) ** 2).sum(2))
        gaps[gaps == 0] = np.inf
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                piece = batch.slice(at, 2_048)
                x = _padded(piece.column("vector"), width)
                x /= np.sqrt((x**2).sum(1))[:, None]
                square = (x**2).sum(1)[:, None] - 2 * x @ coarse.T + (coarse**2).sum(1)
                home = square.argmin(1)
                rows = np.arange(len(x))
                rest = x - coarse[home]
                parts = rest.reshape(len(x), SUBSPACES, -1)
                codes = (((parts[:, :, None] - books[None]) ** 2).sum(3)).argmin(2).astype(np.uint8)
                shown = books[np.arange(SUBSPACES)[None], codes].reshape(len(x), -1)
                error = np.sqrt(((rest - shown) ** 2).sum(1))
                crossing = (square - square[rows, home][:, None]) / (2 * gaps[home])
                crossing[rows, home] = 0
                q, lists = np.nonzero(crossing <= reach + 1e-9)
                take = pa.array(np.concatenate((rows, q)))
                base = piece.select(["label", "rep", "copies", "vector"]).take(take)
                yield pa.RecordBatch.from_arrays(
                    [*base.columns, pa.array(np.concatenate((home, lists)), pa.int32()),
                     pa.array([c.tobytes() for c in codes] + [None] * len(q), pa.binary()),
                     pa.array(np.concatenate((error, np.zeros(len(q)))))],
                    ["label", "rep", "copies", "vector", "list", "code", "error"])

    return file


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: every node with the smallest node of its part."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _link(model: tuple, width: int, threshold: float) -> Callable:
    def link(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return empty
        coarse, books = model
        reach = math.sqrt(2 - 2 * threshold)

        def exact(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lengths = frame["vector"].map(len).to_numpy()
            raw = np.zeros((len(frame), width))
            for i, v in enumerate(frame["vector"]):
                raw[i, : len(v)] = v
            return raw, np.sqrt((raw**2).sum(1)), lengths

        y, y_norm, y_dim = exact(right)
        y_rep, copies, error = right["rep"].to_numpy(np.int64), right["copies"].to_numpy(np.int64), right["error"].to_numpy(float)
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), SUBSPACES)
        x, x_norm, x_dim = exact(left)
        x_rep = left["rep"].to_numpy(np.int64)
        links = np.zeros(len(x), np.int64)
        nodes, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(x), TILE):
            tile = slice(at, at + TILE)
            rest = (x[tile] / x_norm[tile, None] - coarse[key[1]]).reshape(-1, SUBSPACES, 1, width // SUBSPACES)
            table = ((rest - books[None]) ** 2).sum(3)
            for to in range(0, len(y), 4_096):
                part = slice(to, to + 4_096)
                far = sum(table[:, s][:, codes[part, s]] for s in range(SUBSPACES))
                i, j = np.nonzero(far <= (reach + error[part] + 1e-6) ** 2)
                i, j = i + at, j + to
                sure = np.zeros(len(i), bool)
                for c in range(0, len(i), 65_536):
                    ii, jj = i[c: c + 65_536], j[c: c + 65_536]
                    sure[c: c + 65_536] = ((x[ii] * y[jj]).sum(1) / (x_norm[ii] * y_norm[jj]) >= threshold) & (x_dim[ii] == y_dim[jj]) & (x_rep[ii] != y_rep[jj])
                i, j = i[sure], j[sure]
                np.add.at(links, i, copies[j])
                if len(i):
                    nodes, roots = _forest(np.concatenate((nodes, x_rep[i])), np.concatenate((roots, y_rep[j])))
        return pd.concat([
            pd.DataFrame({"rep": x_rep, "links": links, "other": x_rep})[links > 0],
            pd.DataFrame({"rep": nodes, "links": np.zeros(len(nodes), np.int64), "other": roots})]) if links.any() else empty

    return link


def near_vectors(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = SAMPLE_ROWS, cell_rows: int = 2_048, list_rows: int = 8_000) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors`` (vec_id, embedding, label).

    Links join rows of one non-null label with cosine >= threshold in double. A row whose label or vector
    is null, or whose vector is zero, empty or holds null or non-finite components, links with nothing
    and is its own component. Vectors of different lengths never link. Copies of a vector are indexed
    once and counted. The index is fitted on at most ``sample_rows`` distinct vectors, whatever the
    input, and files every vector; there is a list for each ``list_rows`` vectors, 256 at most, and lists are split into cells of about ``cell_rows`` rows on either side.
    vec_id is unique; extra columns are not looked at; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"))
    sound = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0)
             & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(1e150)))
             & F.exists("vector", lambda v: F.abs(v.cast("double")) > F.lit(1e-150)))
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    distinct = checkpointed(keyed.filter("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").select("vector").limit(sample_rows).toArrow()["vector"].combine_chunks()
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    longest = distinct.agg(F.max(F.size("vector"))).first()[0]
    width = -(-longest // SUBSPACES) * SUBSPACES
    points = _padded(sample if isinstance(sample, pa.ListArray) else sample.chunk(0), width)
    points /= np.sqrt((points**2).sum(1))[:, None]
    # labels divide the lists once more, and in high dimensions a query probes most lists: a few large ones do
    lists = int(min(256, max(1, distinct.count() // list_rows)))
    model = train(points, lists)
    kinds = dict(distinct.dtypes)
    filed = checkpointed(distinct.mapInArrow(
        _file(model, width, math.sqrt(2 - 2 * threshold)),
        f"label {kinds['label']}, rep long, copies long, vector {kinds['vector']}, list int, code binary, error double"))
    cells = filed.groupBy("label", "list").agg(
        F.ceil(F.count("code") / cell_rows).cast("int").alias("blocks"), F.ceil((F.count("*") - F.count("code")) / cell_rows).cast("int").alias("turns"))
    placed = filed.join(cells, ["label", "list"])
    turn = F.pmod(F.xxhash64("rep"), F.greatest("turns", F.lit(1))).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.greatest("blocks", F.lit(1))).cast("int")
    asked = placed.filter("code IS NULL AND blocks > 0").withColumn("turn", turn).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = placed.filter("code IS NOT NULL AND turns > 0").withColumn("block", block).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    keys = ["label", "list", "block", "turn"]
    # fresh names on one side: both come from the same rows
    asked = asked.select(*[F.col(k).alias(f"to_{k}") for k in keys], F.col("rep").alias("rep"), F.col("vector").alias("vector"))
    found = checkpointed(asked.groupBy(*[f"to_{k}" for k in keys]).cogroup(held.groupBy(*keys)).applyInPandas(_link(model, width, threshold), "rep long, links long, other long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = (
        distinct.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    return (
        keyed.filter("sound").join(classes, ["label", "vector"])
        .select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
        .unionByName(keyed.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
    )

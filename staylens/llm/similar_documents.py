"""Near copies by exact Jaccard similarity of word shingles, found by prefix keys.

A text is its set of five-word shingles. All shingles stand in one total order, those that a sample of the
texts shares last. Two sets of similarity s or more share a shingle among the first n - ceil(s n) + 1 of
each, so these are a set's keys and no pair is missed, whatever the order. Candidates are checked first by
sizes and by parities and then by the sets themselves. A set's parities are the parities of its shingles in
2 to 4 slots a shingle; the slots in which two sets' parities differ are never more than the shingles in
which the sets differ, and parities of twice the slots fold into those of fewer, so sets of any sizes compare.

Components that another method found may be given; what they connect is not compared again.

Every set is first compared with the set that is first among most of its keys, then with the first sets of its
other keys where they are not yet in its component; both are linear, and a crowd of different near copies
becomes one component by them. Then only the keys that hold several components are compared pair by pair, in
blocks of a fixed number of sets: rows sorted by key reach a task, which compares two blocks at a time with parities
folded to at most 1,024 slots and tells only the pairs that pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed, connected_components, fresh, mark_of, marked, marks, portions, scratch, tidy, utf8

LEAST_SLOTS, SHORT_SLOTS = 512, 1_024
SAMPLE_ROWS, COMMON = 10_000, 200_000
BLOCK = 1_000
#: how many pairs are compared in one step
PAIRS = 100_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hash of each word that a worker has met; the empty word, which pads short texts, has 0."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 11) if word else 0
        return value


def shingle_sets(texts: list[str | None], words: int, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted inside each text, and how many each text has."""
    if len(known) > Words.LIMIT:
        known.clear()
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        tokens = (text or "").encode().lower().split()
        if tokens:
            tokens += [b""] * (words - len(tokens))
        flat += tokens
        counts[i] = len(tokens)
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    spans = np.maximum(0, counts - words + 1)
    owner = np.repeat(np.arange(len(texts)), spans)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(spans) - spans), spans)
    value = np.zeros(len(owner), np.uint64)
    for j in range(words):
        value = _mix(value * STEP + hashes[at + j])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _sampled(words: int) -> Callable:
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in portions(batches, 0, 2_000_000):
            values, _ = shingle_sets(batch.column(0).to_pylist(), words, known)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["shingle"])

    return sampled


def parities(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities of each set, one bit a slot; the number of slots is the power of two from twice the size on."""
    slots = np.maximum(LEAST_SLOTS, 1 << np.ceil(np.log2(np.maximum(1, 2 * sizes))).astype(np.int64))
    ends = np.cumsum(slots)
    odd = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    place = (values & np.repeat(slots - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(ends - slots, sizes)
    np.bitwise_xor.at(odd, place, 1)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(((ends - slots) // 8).tolist(), (ends // 8).tolist(), strict=True)]


def shortened(parity: bytes) -> bytes:
    """Parities folded to SHORT_SLOTS where they have more."""
    words = SHORT_SLOTS // 64
    return parity if len(parity) <= 8 * words else np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, words), axis=0).tobytes()


def prefix(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many first shingles of a set are its keys."""
    return np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)


def _described(words: int, similarity: float, common: object) -> Callable:
    """(doc_id, digest of the set, size, parities, keys) of each row."""
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        shared, times = common.value
        for batch in portions(batches, 1, 2_000_000):
            values, sizes = shingle_sets(batch.column(1).to_pylist(), words, known)
            n = len(sizes)
            owner = np.repeat(np.arange(n), sizes)
            parity = parities(values, sizes)
            rank = np.zeros(len(values), np.int64)
            if len(shared):
                place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
                rank = np.where(shared[place] == values, times[place], 0)
            order = np.lexsort((values, rank, owner))
            kept = prefix(sizes, similarity)
            first = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(kept, sizes)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), pa.array(values[order][first].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(_digests(values, sizes), pa.binary()), pa.array(sizes, pa.int64()), pa.array(parity, pa.binary()), pa.array(map(shortened, parity), pa.binary()), keys],
                ["doc_id", "text_key", "digest", "size", "parity", "short", "keys"])

    return described


def _sets(words: int, wanted: object) -> Callable:
    """(digest, shingles) of the rows (text, slot) whose slot is marked."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Words(), wanted.value
        for whole in batches:
            some = whole.filter(pa.array(marked(bits, whole.column(1).to_numpy())))
            for batch in portions(iter([some]), 0, 2_000_000):
                values, sizes = shingle_sets(batch.column(0).to_pylist(), words, known)
                ends = np.cumsum(sizes)
                raw = [values[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_digests(values, sizes), pa.binary()), pa.array(raw, pa.binary())], ["digest", "shingles"])

    return sets


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many slots parities differ, row by row; the longer ones are folded to the length of the others."""
    while x.shape[1] != y.shape[1]:
        if x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
        else:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _possible(similarity: float) -> Callable:
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, x_size, y_size, x_parity, y_parity) whose parities differ no more than sets of this similarity can."""
        for batch in batches:
            if batch.num_rows:
                x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                found = np.zeros(batch.num_rows, np.int64)
                kinds = np.fromiter((len(u) << 32 | len(v) for u, v in zip(x, y, strict=True)), np.int64, len(x))
                for kind in np.unique(kinds).tolist():
                    own = np.flatnonzero(kinds == kind)
                    found[own] = differing(*(np.frombuffer(b"".join([z[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1) for z in (x, y)))
                both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                good = found <= both * ((1 - similarity) / (1 + similarity)) + 1e-6
                yield batch.select([0, 1]).filter(pa.array(good))

    return possible


def _similar(similarity: float) -> Callable:
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, x, y) whose sets x and y are similar."""
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return similar


def _verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose shingle sets have the similarity."""
    x = distinct.select(F.col("node").alias("a"), F.col("size").alias("x_size"), F.col("parity").alias("x_parity"))
    y = distinct.select(F.col("node").alias("b"), F.col("size").alias("y_size"), F.col("parity").alias("y_parity"))
    met = pairs.join(x, "a").join(y, "b").filter(F.least("x_size", "y_size") >= F.greatest("x_size", "y_size") * similarity - 1e-6)
    near = checkpointed(met.select("a", "b", "x_size", "y_size", "x_parity", "y_parity").mapInArrow(_possible(similarity), "a long, b long"))
    wanted = checkpointed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "rep", "digest"), "node"))
    # one bit a slot keeps most texts out of the join; it is the join by digest that decides
    shared = rows.sparkSession.sparkContext.broadcast(marks(wanted, "rep"))
    found = rows.select("text", mark_of("doc_id").alias("slot")).mapInArrow(tidy(_sets(words, shared)), "digest binary, shingles binary")
    sets = checkpointed(found.groupBy("digest").agg(F.first("shingles").alias("shingles")).join(wanted.select("node", "digest"), "digest").select("node", "shingles"))
    full = near.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return checkpointed(full.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"))


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parities of LEAST_SLOTS or SHORT_SLOTS: all folded to the fewer slots, as they are, and which have the more."""
    data, offsets = utf8(column)
    more = np.diff(offsets) > LEAST_SLOTS // 8
    folded, whole = np.zeros((len(more), LEAST_SLOTS // 64), np.uint64), np.zeros((len(more), SHORT_SLOTS // 64), np.uint64)
    for own, slots in ((np.flatnonzero(~more), LEAST_SLOTS), (np.flatnonzero(more), SHORT_SLOTS)):
        words = data[offsets[own][:, None] + np.arange(slots // 8)].view(np.uint64)
        whole[own, : slots // 64] = words
        folded[own] = np.bitwise_xor.reduce(words.reshape(len(own), slots // LEAST_SLOTS, LEAST_SLOTS // 64), axis=1)
    return folded, whole, more


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches cut anew so that rows which agree in the columns, and follow each other, are never parted."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.slice(batch.num_rows - 1).select(columns).to_pylist()[0]
        inside = np.ones(batch.num_rows, bool)
        for c in columns:
            inside &= batch.column(c).to_numpy() == last[c]
        cut = int(np.flatnonzero(~inside)[-1]) + 1 if not inside.all() else 0
        if cut or (rest and rest[-1].slice(rest[-1].num_rows - 1).select(columns).to_pylist()[0] != last):
            # rows up to the cut end the group that waited
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _passing(similarity: float) -> Callable:
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) of two blocks of a key, of different components, whose sizes and parities allow the similarity."""
        share = (1 - similarity) / (1 + similarity)
        for batch in _groups(batches, ["key", "p", "q"]):
            key, p, q, side, node, size, component = (batch.column(c).to_numpy() for c in ("key", "p", "q", "side", "node", "size", "component"))
            folded, whole, more = _folded(batch.column("parity"))
            n, at = len(key), np.arange(len(key))
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            ends = np.repeat(starts + sizes, sizes)
            # inside one block a row meets those behind it, else a row of the first block all of the second
            first = np.where(p == q, at + 1, ends - np.repeat(np.add.reduceat(side, starts), sizes))
            counts = np.where(side == 0, ends - first, 0)
            total = np.cumsum(counts)
            row = 0
            while row < n:
                stop = max(row + 1, int(np.searchsorted(total, total[row] - counts[row] + PAIRS, "right")))
                own = counts[row:stop]
                x = np.repeat(at[row:stop], own)
                y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[row:stop], own)
                row = stop
                apart = component[x] != component[y]
                x, y = x[apart], y[apart]
                m, k = size[x], size[y]
                fits = np.minimum(m, k) >= np.maximum(m, k) * similarity - 1e-6
                x, y = x[fits], y[fits]
                allowed = (size[x] + size[y]) * share + 1e-6
                good = np.bitwise_count(folded[x] ^ folded[y]).sum(1, dtype=np.int64) <= allowed
                x, y, allowed = x[good], y[good], allowed[good]
                good = ~(more[x] & more[y]) | (np.bitwise_count(whole[x] ^ whole[y]).sum(1, dtype=np.int64) <= allowed)
                a, b = node[x[good]], node[y[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return passing


def _across(members: DataFrame, block: int, similarity: float, described: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key but not a component and may be similar, from ``members`` (key, node, component), which have
    size and parity as well unless ``described`` (node, size, parity) tells them.

    A key of more than ``block`` sets is split by hash, and each two parts of it meet under a key of their own.
    Parities are fetched only for keys that hold several components.
    """
    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    held = members.join(mixed.select("key", F.ceil(F.col("n") / block).cast("long").alias("parts")), "key")
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    held = held if described is None else held.join(described, "node")
    met = held.select(
        "key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"), "node", "size", "parity", "component",
    ).select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("other") < F.col("part")).cast("int").alias("side"), "node", "size", "parity", "component")
    dealt = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side")
    return dealt.mapInArrow(_passing(similarity), "a long, b long").distinct()


def _linked(known: DataFrame, described: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``known`` components (doc_id, text_key, component) say of nodes: a label, equal only where they are connected, and links (a, b) that connect them."""
    held = described.select("doc_id", "text_key", "digest").join(known, ["doc_id", "text_key"]).select("digest", "component").distinct()
    placed = checkpointed(held.join(distinct.select("digest", "node"), "digest").select("node", "component"))
    labels = placed.groupBy("node").agg(F.min("component").alias("label"))
    first = placed.groupBy("component").agg(F.min("node").alias("a"))
    return labels, placed.join(first, "component").filter("a <> node").select("a", F.col("node").alias("b"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, text_key, component, component_id), one for each row with a doc_id; text_key is xxhash64 of the text.

    component names the group; component_id is the smallest doc_id in it.

    Links join texts whose sets of ``words``-word shingles have at least this Jaccard similarity: all such
    pairs count and no others (shingles are known by 64-bit hashes). Texts without words (null, empty) are one
    group. Texts of fewer words than a shingle are one shingle. Repeated rows stay repeated, and different texts
    under one doc_id each have their own component; an empty table gives no rows; other columns are not looked at.

    ``known`` gives components (doc_id, text_key, component) found by other means, one row for each row with a doc_id: they are connected as well, and
    texts that they connect are not compared again.
    """
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    # a sample only sets the order of shingles; what is found does not depend on it
    step = max(1, rows.count() // SAMPLE_ROWS)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    often = sample.mapInArrow(tidy(_sampled(words)), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shared, times = often["shingle"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy().astype(np.int64)
    order = np.argsort(shared)
    common = docs.sparkSession.sparkContext.broadcast((shared[order], times[order]))
    described = checkpointed(rows.mapInArrow(tidy(_described(words, similarity, common)), "doc_id long, text_key long, digest binary, size long, parity binary, short binary, keys array<long>"))
    distinct = checkpointed(
        described.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "parity", "short", "keys")])
        .withColumn("node", F.monotonically_increasing_id()))
    filed = distinct.select(F.explode("keys").alias("key"), "node")
    # the frame only grows; rows of a crowded key that memory does not hold go to disk
    inside = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = checkpointed(filed.select("key", "node", F.first("node").over(inside).alias("first")).filter("node <> first"))
    stars = checkpointed(later.groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys")))
    open_, told = stars, None
    if known is not None:
        labels, told = _linked(known, described, distinct)
        open_ = checkpointed(
            stars.join(labels.withColumnsRenamed({"node": "a", "label": "x"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "y"}), "b")
            .filter("x <> y").select("a", "b", "keys"))
    # the first set of most of a set's keys, then the others that are not in its component by then
    nearest = open_.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a"))
    links = _verified(nearest.select("a", "b"), distinct, rows, words, similarity)
    links = links if told is None else links.unionByName(told)
    parts = connected_components(links)
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    apart = open_.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    links = checkpointed(links.unionByName(_verified(apart, distinct, rows, words, similarity)))
    parts = connected_components(links)
    members = later.select("key", "node").unionByName(later.select("key", F.col("first").alias("node")).distinct())
    named = checkpointed(members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    more = _verified(_across(named, block, similarity, distinct.select("node", "size", F.col("short").alias("parity"))), distinct, rows, words, similarity)
    whole = connected_components(links.unionByName(more))
    placed = distinct.select("node", "digest", "rep").join(whole, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return described.select("doc_id", "text_key", "digest").join(placed.join(lowest, "component").select("digest", "component", "component_id"), "digest").drop("digest")


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, known: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest doc_id of their group, and of several texts under it the one of the smallest xxhash64.

    Repeated rows stay as often as they come; rows without doc_id stay. Columns may have any names. ``known`` gives the known components
    of ``docs``. Of the tables made on the way only two numbers a kept document stay on disk.
    """
    name, key = (fresh(docs.columns, x) for x in ("kept_doc_id", "kept_text_key"))
    with scratch(docs.sparkSession) as lasting:
        groups = similar_groups(docs, words, similarity, known=known and known(docs))
        first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
        kept = lasting(first.select(F.col("x.doc_id").alias(name), F.col("x.text_key").alias(key)))
    marked = docs.join(kept, (docs["doc_id"].cast("long") == F.col(name)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key)), "left")
    return marked.filter(F.col(name).isNotNull() | docs["doc_id"].isNull()).drop(name, key)

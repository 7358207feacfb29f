"""Exact removal of repeated byte strings across documents by distributed suffix arrays.

Every window of ``length`` bytes is assigned to an anchor, the leftmost least-hashed ``GRAM``-byte string
inside it, which equal windows share. Windows in a row with one anchor form a segment, about one for each
35 bytes. Segments meet by the hash of their anchor; equal segments need only their first occurrence, and
an anchor with one distinct segment needs nothing more. The distinct segments of an anchor are joined and
their suffix array is built by linear grouping; windows that are equal stand side by side there. Anchors
with more than ``GROUP`` distinct segments (very common lines) are split into their single windows, which
meet by hash, first within each task. All steps are cut by hash ranges whose number follows the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed, mark_of, marked, marks, portions, tidy, utf8
from staylens.llm.suffix_array import suffix_arrays

GRAM, GROUP = 32, 16
#: bytes of one long text, and of short texts together, whose windows a task hashes at once; some ten numbers stand beside each byte
PIECE, PORTION = 8_000_000, 500_000
PLACES = np.uint64((1 << 24) - 1)
RECORD = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
PARTS = "bucket long, kind int, blob binary"
FOUND = "kind int, doc_id long, start int, stop int, h long"
SEGMENTS, REMOVED, CONTENTS = 0, 1, 2


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    with np.errstate(over="ignore"):
        value, factor, size = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while size < GRAM:
            value = value[:-size] * factor + value[size:]
            factor, size = factor * factor, size * 2
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    return value


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, last window, anchor hash) of each segment of texts that follow each other.

    Windows are numbered by their places in ``data``, which is shorter than 2^24 bytes.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    value = grams(data)
    least = value & ~PLACES | np.arange(len(value), dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size:])
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    window = np.arange(len(text)) + np.repeat(offsets[:-1] - (ends - counts), counts)
    if not len(window):
        return empty, empty, empty, empty.astype(np.uint64)
    anchor = (least[window] & PLACES).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(window)) - 1
    return text[first], window[first], window[last], value[anchor[first]]


def _collapse(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each (h, c), and the later ones; the same place seen twice is no later one."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["c"], rows["h"]))]
    new = np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1]))) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    first = rows[np.repeat(at, np.diff(np.append(at, len(rows))))]
    later = ~new & ((rows["doc"] != first["doc"]) | (rows["start"] != first["start"]))
    return rows[new], rows[later]


def _batch(columns: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c[0] for c in columns], pa.int64()), pa.array([c[1] for c in columns], pa.int32()), pa.array([c[2] for c in columns], pa.binary())],
        ["bucket", "kind", "blob"])


def _sent(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """First occurrences by bucket of their hash, later ones spread over the buckets as known removals."""
    kept, later = _collapse(rows)
    bucket = (kept["h"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = kept[order], bucket[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    out = [(int(bucket[a]), SEGMENTS, _columns(kept[a:b])) for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True)]
    for k, a in enumerate(range(0, len(later), 20_000)):
        some = later[a: a + 20_000]
        out.append((int(some["h"][0] % np.uint64(buckets)) if k % 2 else int(some["c"][0] % np.uint64(buckets)), REMOVED, _columns(some)))
    return _batch(out)


def _columns(rows: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in RECORD.names)


def _rows(blob: bytes) -> np.ndarray:
    n, at = len(blob) // RECORD.itemsize, 0
    rows = np.empty(n, RECORD)
    for f in RECORD.names:
        rows[f] = np.frombuffer(blob, RECORD[f], n, at)
        at += n * RECORD[f].itemsize
    return rows


def _anchored(length: int, buckets: int) -> Callable:
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for batch in portions(batches, 1, PORTION):
            data, offsets = utf8(batch.column(1))
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # a text beyond PIECE bytes is alone in its portion and is cut into overlapping stretches
            for base in range(0, max(1, len(data)), PIECE) if len(names) == 1 else (0,):
                part = data[base: base + PIECE + length - 1] if len(names) == 1 else data
                own = np.array([0, len(part)]) if len(names) == 1 else offsets
                text, first, last, h = segments(part, own, length)
                raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
                rows = np.empty(len(text), RECORD)
                rows["h"], rows["doc"] = h, names[text]
                rows["c"] = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                rows["start"], rows["size"] = first - own[text] + base, last - first + length
                held.append(rows)
                count += len(rows)
            if count > 500_000:
                yield _sent(np.concatenate(held), buckets)
                held, count = [], 0
        if count:
            yield _sent(np.concatenate(held), buckets)

    return anchored


def _table(kinds: np.ndarray, rows: np.ndarray) -> pa.Table:
    return pa.table({
        "kind": pa.array(kinds, pa.int32()), "doc_id": pa.array(rows["doc"]), "start": pa.array(rows["start"]),
        "stop": pa.array(rows["start"] + rows["size"]), "h": pa.array(rows["h"].view(np.int64))})


def _met(key: tuple, table: pa.Table) -> pa.Table:
    """Removals, and the segments whose contents must be compared: kind 1 removed, 2 suffix array, 3 single windows."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    fresh = [_rows(b) for k, b in zip(kinds, blobs, strict=True) if k == SEGMENTS]
    known = [_rows(b) for k, b in zip(kinds, blobs, strict=True) if k == REMOVED]
    kept, later = _collapse(np.concatenate(fresh)) if fresh else (np.empty(0, RECORD), np.empty(0, RECORD))
    at = np.flatnonzero(np.concatenate(([True], kept["h"][1:] != kept["h"][:-1]))) if len(kept) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(kept)))
    share = np.repeat(size, size)
    kept, share = kept[share > 1], share[share > 1]
    removed = np.concatenate([*known, later])
    return _table(np.concatenate((np.full(len(removed), 1), np.where(share <= GROUP, 2, 3))), np.concatenate((removed, kept)))


def _pressed(shared: object) -> Callable:
    """(doc_id, name, text_key, packed) of the rows (doc_id, text, name, text_key, slot) whose slot is marked."""
    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, bits = zstandard.ZstdCompressor(level=3), shared.value
        for whole in batches:
            some = whole.filter(pa.array(marked(bits, whole.column(4).to_numpy())))
            for batch in portions(iter([some]), 1):
                data, offsets = utf8(batch.column(1))
                raw = data.tobytes()
                blobs = [press.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(blobs, pa.binary())], ["doc_id", "name", "text_key", "packed"])

    return pressed


def _untouched(shared: object) -> Callable:
    """Result rows of the rows (doc_id, text, name, text_key, slot) whose slot is not marked."""
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            batch = whole.filter(pa.array(~marked(bits, whole.column(4).to_numpy())))
            _, offsets = utf8(batch.column(1))
            none = pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(np.diff(offsets)), none, none, batch.column(1).cast(pa.binary())], ["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept"])

    return untouched


def _fetched(length: int, buckets: int) -> Callable:
    """Contents of the segments to compare, by bucket; very common anchors' windows one by one."""
    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_128_intdigest
        windows: list[tuple] = []
        contents: dict[int, list[bytes]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if windows:
                yield _sent(np.array(windows, RECORD), buckets)
            if contents:
                yield _batch([(b, CONTENTS, b"".join(x)) for b, x in sorted(contents.items())])
            windows.clear()
            contents.clear()
            held = 0

        for batch in batches:
            for doc, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = unpress.decompress(packed)
                for x in wanted:
                    part = raw[x["start"]: x["stop"]]
                    if x["kind"] == 2:
                        h = x["h"] & 0xFFFFFFFFFFFFFFFF
                        head = np.array([(h, 0, doc, x["start"], len(part))], RECORD).tobytes()
                        contents.setdefault(h % buckets, []).append(head + part)
                        held += len(part)
                    else:
                        for k in range(len(part) - length + 1):
                            value = digest(part[k: k + length])
                            windows.append((value >> 64, value & 0xFFFFFFFFFFFFFFFF, doc, x["start"] + k, length))
                        held += 200 * (len(part) - length + 1)
                if held > 32_000_000:
                    yield from flushed()
        yield from flushed()

    return fetched


def _parsed(blobs: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    heads, parts = [], []
    for blob in blobs:
        at = 0
        while at < len(blob):
            head = np.frombuffer(blob, RECORD, 1, at)[0]
            at += RECORD.itemsize
            heads.append(head)
            parts.append(blob[at: at + int(head["size"])])
            at += int(head["size"])
    return np.array(heads, RECORD), parts


def repeated_windows(heads: np.ndarray, parts: list[bytes], length: int, letters: int = 600_000) -> np.ndarray:
    """Windows of segments that a segment of the same anchor holds earlier, found by suffix arrays."""
    # a repeated row brings its segments again
    _, order = np.unique(heads[["h", "doc", "start"]], return_index=True)
    heads, parts = heads[order], [parts[i] for i in order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], heads["h"][1:] != heads["h"][:-1]))), len(heads))
    sizes = np.add.reduceat(heads["size"].astype(np.int64) + 1, cuts[:-1])
    out = []
    todo = np.argsort(sizes, kind="stable")  # texts of like size advance together
    at = 0
    while at < len(todo):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[todo[at:]]), letters)) + at)
        groups = todo[at:stop]
        at = stop
        members = [m for g in groups for m in range(cuts[g], cuts[g + 1])]
        end = np.cumsum(sizes[groups])
        # a segment ends in 1, the last of its group in 0; bytes are letters from 2 on
        raw = np.frombuffer(b"".join([parts[m] + b"\0" for m in members]), np.uint8).astype(np.int64) + 2
        lengths = heads["size"][members].astype(np.int64)
        close = np.cumsum(lengths + 1) - 1
        raw[close] = 1
        raw[end - 1] = 0
        array = suffix_arrays(raw, end - sizes[groups], end)
        of = np.searchsorted(close, array)
        left = close[of] - array
        good = left >= length
        place, of = array[good], of[good]
        doc = heads["doc"][members][of]
        start = heads["start"][members][of].astype(np.int64) + lengths[of] - (close[of] - place)
        same = np.zeros(len(place), bool)
        group = np.searchsorted(end, place, "right")
        near = np.flatnonzero(group[1:] == group[:-1])
        for k in range(0, len(near), 20_000):
            some = near[k: k + 20_000]
            step = np.arange(length)
            same[some + 1] = (raw[place[some][:, None] + step] == raw[place[some + 1][:, None] + step]).all(1)
        run = np.cumsum(~same)
        by = np.lexsort((start, doc, run))
        first = np.concatenate(([True], run[by][1:] != run[by][:-1]))
        rows = np.zeros(len(by), RECORD)
        rows["doc"], rows["start"], rows["size"] = doc[by], start[by], length
        out.append(rows[~first])
    return np.concatenate(out) if out else np.empty(0, RECORD)


def _joined(rows: np.ndarray) -> np.ndarray:
    """Overlapping or touching stretches of a document as one."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    if not len(rows):
        return rows
    stop = rows["start"].astype(np.int64) + rows["size"] + (np.searchsorted(np.unique(rows["doc"]), rows["doc"]).astype(np.int64) << 32)
    begin = stop - rows["size"]
    reach = np.maximum.accumulate(stop)
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    merged = rows[first].copy()
    merged["size"] = reach[np.append(first[1:], len(rows)) - 1] - begin[first]
    return merged


def _compared(length: int) -> Callable:
    def compared(key: tuple, table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        own = {k: [b for x, b in zip(kinds, blobs, strict=True) if x == k] for k in (SEGMENTS, REMOVED, CONTENTS)}
        out = [_rows(b) for b in own[REMOVED]]
        if own[SEGMENTS]:
            out.append(_collapse(np.concatenate([_rows(b) for b in own[SEGMENTS]]))[1])
        if own[CONTENTS]:
            out.append(repeated_windows(*_parsed(own[CONTENTS]), length))
        rows = _joined(np.concatenate(out))
        return _table(np.full(len(rows), 1), rows)

    return compared


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows: tuple[list, ...] = ([], [], [], [])
            for packed, ranges in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                raw = unpress.decompress(packed)
                n = len(raw)
                edge = np.zeros(n + 1, np.int64)
                if ranges:
                    np.add.at(edge, np.minimum([r["start"] for r in ranges], n), 1)
                    np.add.at(edge, np.minimum([r["stop"] for r in ranges], n), -1)
                gone = np.cumsum(edge)[:n] > 0
                spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))) if n else 0
                for column, value in zip(rows, (n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())],
                ["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept"])


def _ordered(named: DataFrame) -> DataFrame:
    """``named`` (doc_id, text, text_key) with the place of each text in the order as doc_id, and the id itself as name.

    The id is the place where it names one text. Where some id names several, distinct (id, text) pairs are
    numbered in their order, which a sort by ranges gives without bringing them together.
    """
    own = named.select("doc_id", "text_key")
    if own.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).filter("a < b").isEmpty():
        return named.withColumn("name", F.col("doc_id"))
    ranked = checkpointed(
        checkpointed(own.distinct()).repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
        .select("doc_id", "text_key", F.monotonically_increasing_id().alias("place")))
    return named.join(ranked, ["doc_id", "text_key"]).select(F.col("place").alias("doc_id"), "text", "text_key", F.col("doc_id").alias("name"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Rows (doc_id, text_key, n_bytes, n_removed, n_spans, kept binary), one for each input row; text_key is xxhash64 of the text.

    Removed is each byte of a ``length``-byte string that also starts earlier: in a smaller doc_id, or in
    the same document. Strings are judged on the input; matches never cross documents. A null text counts
    as empty. A repeated row is no earlier occurrence of itself and is cut like its twin; different texts
    under one doc_id are documents of their own, in the order of text_key. Rows without doc_id have no place
    in the order: they are kept whole and remove nothing. Other columns are not looked at; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    named = _ordered(rows.filter("doc_id IS NOT NULL")).select("doc_id", "text", "name", "text_key")
    buckets = max(64, -(-docs.count() // 1_000))
    met = checkpointed(named.select("doc_id", "text").mapInArrow(tidy(_anchored(length, buckets)), PARTS).groupBy("bucket").applyInArrow(_met, FOUND))
    context = docs.sparkSession.sparkContext
    slotted = named.withColumn("slot", mark_of("doc_id"))

    def packed(bits: object) -> DataFrame:
        return slotted.mapInArrow(tidy(_pressed(bits)), "doc_id long, name long, text_key long, packed binary")

    # a bit a slot keeps texts that need nothing out of the joins, which decide
    asked = met.filter("kind > 1")
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "stop", "h")).alias("wanted"))
    compared = (
        packed(context.broadcast(marks(asked, "doc_id"))).join(wanted, "doc_id").select("doc_id", "packed", "wanted").mapInArrow(tidy(_fetched(length, buckets)), PARTS)
        .groupBy("bucket").applyInArrow(_compared(length), FOUND)
    )
    # copies of a row find the same ranges
    found = checkpointed(met.filter("kind = 1").unionByName(compared).select("doc_id", "start", "stop").distinct())
    ranges = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = context.broadcast(marks(found, "doc_id"))
    schema = "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept binary"
    whole = F.col("text").cast("binary")
    return (
        packed(cut).join(ranges, "doc_id", "left").select("name", "text_key", "packed", "ranges").mapInArrow(tidy(_cut), schema)
        .unionByName(slotted.mapInArrow(tidy(_untouched(cut)), schema))
        .unionByName(rows.filter("doc_id IS NULL").select(
            "doc_id", "text_key", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
            F.lit(0).cast("long").alias("n_spans"), whole.alias("kept")))
    )

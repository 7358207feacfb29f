"""Exact encoding and decoding with a piece model by a table of distinct marked words.

The model writes every space as a marker, and no piece holds a marker behind another letter. So a text falls into
chunks, each a run of markers and the letters up to the next one, and no merge crosses a chunk's border. Each
distinct chunk is segmented once: frequent ones in a table that all tasks share, others in the table of their task.
The ids of a text are its chunks' ids joined by position.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import CACHES, checkpointed, portions, tidy

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: longest chunk that outlives its portion of texts
KEPT_LETTERS = 40
#: chunks that a task keeps between portions besides the shared ones
OWN_CHUNKS = 100_000
NONE = float("inf")
LAST = 1 << 30


def chunks_of(text: str) -> list[str]:
    """The marked words of a text in order; an empty text has none."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceModel:
    """Vocabulary of a model file and the exact merges of one chunk."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        special = {i for i in range(len(names)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.id_of = {x: i for i, x in enumerate(names) if i not in special}
        self.cost = {x: -model.get_score(i) for x, i in self.id_of.items()}
        if not all(map(model.is_byte, self.byte_ids)) or model.normalize(" \ta  b ") != f"{MARK}{MARK}\ta{MARK}{MARK}b{MARK}":
            raise ValueError("the model must fall back to bytes and keep texts as they are but for the markers")
        if any(map(model.is_unused, range(len(names)))) or any(re.search(f"[^{MARK}]{MARK}", x) for x in self.id_of):
            raise ValueError("pieces must be in use and hold no marker behind another letter")
        byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        #: what each id adds to a decoded text
        self.spelled = [b"" if model.is_control(i) else bytes([byte_of[i]]) if i in byte_of else b" \xe2\x81\x87 " if i == self.unknown else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.controls, self.bytes = {i for i in special if model.is_control(i)}, set(byte_of)
        self.marked = {i for x, i in self.id_of.items() if x.startswith(MARK)}
        letters = sorted((ord(x), i) for x, i in self.id_of.items() if len(x) == 1)
        self.points, self.point_ids = (np.array(x, np.int64) for x in zip(*letters, strict=True))
        order = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        pairs = sorted((self.id_of[x[:k]] << 20 | self.id_of[x[k:]], order[self.cost[x]], i)
                       for x, i in self.id_of.items() for k in range(1, len(x)) if x[:k] in self.id_of and x[k:] in self.id_of)
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: of all neighbours that form a piece, the pair of best score merges first, the leftmost of equals."""
        parts = list(chunk)
        if len(parts) > 48:
            parts = self._merge_long(parts)
        else:
            cost = self.cost.get
            while len(parts) > 1:
                pairs = list(map(add, parts, parts[1:]))
                costs = [cost(x, NONE) for x in pairs]
                least = min(costs)
                if least == NONE:
                    break
                i = costs.index(least)
                parts[i: i + 2] = [pairs[i]]
        ids, known = [], self.id_of.get
        for part in parts:
            i = known(part)
            if i is None:
                ids += [self.byte_ids[b] for b in part.encode()]
            else:
                ids.append(i)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each two neighbours by score (LAST where they form no piece) and the piece's id."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], LAST), self.pair_ids[at]

    def segment_many(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks as little-endian uint32 bytes: in each round every chunk merges its one best pair.

        Chunks that are long, or hold letters beyond ASCII that are no pieces, are segmented one by one.
        """
        out = [b""] * len(chunks)
        own = [i for i, c in enumerate(chunks) if len(c) <= 48]
        sizes = np.fromiter((len(chunks[i]) for i in own), np.int64, len(own))
        points = np.frombuffer("".join([chunks[i] for i in own]).encode("utf-32-le"), np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        ids = np.where(self.points[place] == points, self.point_ids[place], -1)
        plain = np.flatnonzero((ids < 0) & (points < 128))
        ids[plain] = np.array(self.byte_ids, np.int64)[points[plain]]  # byte ids are in no pair
        word, names = np.repeat(np.arange(len(own)), sizes), np.array(own, np.int64)
        odd = np.zeros(len(own), bool)
        odd[word[ids < 0]] = True
        for i in [*names[odd].tolist(), *set(range(len(chunks))).difference(own)]:
            out[i] = np.array(self.segment(chunks[i]), "<u4").tobytes()
        whole = ~odd[word]
        ids, word = ids[whole], word[whole]
        rank, made = np.full(len(ids), LAST), np.zeros(len(ids), np.int64)

        def rate(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(ids) - 1)]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self._ranks(ids[at], ids[at + 1])

        rate(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), starts)
            done = best >> 32 == LAST
            if done.any():
                stops = np.append(starts[1:], len(ids))
                flat = ids.astype("<u4").tobytes()
                for i, a, b in zip(names[word[starts[done]]].tolist(), (4 * starts[done]).tolist(), (4 * stops[done]).tolist(), strict=True):
                    out[i] = flat[a:b]
            at = best[~done] & 0xFFFFFFFF
            keep = np.repeat(~done, np.diff(np.append(starts, len(ids))))
            ids[at] = made[at]
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            ids, word, rank, made = ids[keep], word[keep], rank[keep], made[keep]
            rank[moved] = LAST
            rank[moved[moved > 0] - 1] = np.where(word[moved[moved > 0] - 1] == word[moved[moved > 0]], LAST, rank[moved[moved > 0] - 1])
            rate(np.concatenate([moved, moved - 1]))
        return out

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges by a heap over a linked list: n log n for chunks of any length."""
        n = len(parts)
        after, before, cost = list(range(1, n + 1)), list(range(-1, n - 1)), self.cost.get
        heap = [(c, i, 2) for i in range(n - 1) if (c := cost(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # one of both has merged since: lengths only grow, and a merged part is empty
            if j >= n or not parts[i] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (c := cost(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (c, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one marker at the start goes, the others are spaces, bytes that are no UTF-8 are replaced one by one. Control ids part bytes."""
        runs = [list(run) for control, run in groupby(ids, self.controls.__contains__) if not control]
        out = []
        for k, run in enumerate(runs):
            raw = b"".join(map(self.spelled.__getitem__, run))[k == 0 and run[0] in self.marked:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(raw.decode("utf-8", "surrogateescape").translate(_REPLACED))
        return "".join(out)


_REPLACED = {c: "�" for c in range(0xDC80, 0xDD00)}


class ChunkTable(dict):
    """Ids of distinct chunks as little-endian uint32 bytes; a portion's new chunks are segmented together."""

    def __init__(self, model: PieceModel, shared: dict[str, bytes] | None = None):
        super().__init__(shared or {})
        self.model, self.room, self.own = model, len(self) + OWN_CHUNKS, []

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table does not hold yet."""
        new = list(chunks.difference(self))
        for at in range(0, len(new), 50_000):
            some = new[at: at + 50_000]
            self.update(zip(some, self.model.segment_many(some), strict=True))
        self.own += new

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts with those of begin and end."""
        cut = [chunks_of(t) for t in texts]
        self.learn(set().union(*cut))
        begin, end = (x.to_bytes(4, "little") for x in (self.model.begin, self.model.end))
        find = self.__getitem__
        return [b"".join([begin, *map(find, c), end]) for c in cut]

    def shrink(self) -> None:
        """Between portions: chunks met in the last one stay where they are short and there is room."""
        for chunk in self.own:
            if len(chunk) > KEPT_LETTERS or len(self) > self.room:
                del self[chunk]
        self.own.clear()


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 0):
        seen: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            seen.update(chunks_of(text or ""))
        kept = {c: n for c, n in seen.items() if n > 1 and len(c) <= KEPT_LETTERS}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["chunk", "n"])


_tables: dict[tuple, ChunkTable] = {}
CACHES.append(_tables)


def _table(path: str, shared: object = None, name: str = "") -> ChunkTable:
    """This worker's table; one is kept for each model and set of shared chunks, which has a name."""
    key = path, name
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(PieceModel(path), shared.value if shared else None)
    return _tables[key]


def _segment_rows(path: str) -> Callable:
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            table.learn(set(chunks))
            ids = [table[c] for c in chunks]
            table.shrink()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["chunk", "ids"])

    return segment


def shared_chunks(docs: DataFrame, path: str, size: int = 1 << 17) -> dict[str, bytes]:
    """The most frequent chunks of all texts with their ids, at most ``size`` of them and 40 letters each.

    Counts come from all texts, leaving out chunks that a portion of 4 MB holds once. The least power of two that at most ``size``
    counts reach is the threshold, so only as many rows as that come to the driver. Each is segmented once, in tasks.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(tidy(_count_chunks), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted.withColumn("level", F.floor(F.log2("n")).cast("int")))
    chosen, held = None, 0
    for level, n in sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        held += n
        if held > size:
            break
        chosen = level
    if chosen is None:
        return {}
    ids = counted.filter(F.col("level") >= chosen).select("chunk").mapInArrow(tidy(_segment_rows(path), keep=True), "chunk string, ids binary")
    return {r["chunk"]: bytes(r["ids"]) for r in ids.collect()}


def _encode_rows(path: str, shared: object) -> Callable:
    name = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path, shared, name)
        for batch in portions(batches, 1):
            ids = table.encode_many([t or "" for t in batch.column(1).to_pylist()])
            table.shrink()
            decoded = [table.model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return encode


def encode_decode(docs: DataFrame, path: str, table_size: int = 1 << 17) -> DataFrame:
    """Rows (doc_id, ids binary: little-endian uint32 with begin and end, decoded string), one for each input row.

    ``path``: a BPE piece model that every worker can read; others are refused. A null text counts as empty and has only begin
    and end. doc_id may be null or repeat, an empty table gives no rows, and other columns are not looked at. The shared table
    (at most ``table_size`` chunks, about 10 MB) is all that is broadcast; its contents change the speed and never the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, table_size))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_encode_rows(path, shared), keep=True), "doc_id long, ids binary, decoded string")

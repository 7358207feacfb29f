"""Token counts that follow edits.

A document is cut into units at places where a space stands between two other characters; tokens never
depend on each other across such a place. Units are the leaves of a segment tree that sums characters and
tokens. An edit descends by characters to the leaves it touches, re-encodes only these and one unit of
context on either side, and updates the sums on the paths above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.bpe import Encoder, compile_lexicon, encoder, frequent_words
from staylens.llm.common import portions, tidy, utf8

#: white space of one byte, and that of two and three bytes as numbers
NARROW = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
WIDE = np.array(sorted(int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 65_536)) if c.isspace()))


def _spaced(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is white space."""
    out = NARROW[data[at]]
    for lead, size in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        own = np.flatnonzero(data[at] == lead)
        out[own] = np.isin(sum(data[at[own] + k].astype(np.int64) << 8 * (size - 1 - k) for k in range(size)), WIDE)
    return out


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of UTF-8 bytes where units begin: texts, and spaces that stand between two other characters of one text.

    Texts follow each other, each from one of ``offsets`` (n + 1) to the next; an empty text is a unit without bytes.
    """
    space = np.flatnonzero(data == 32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    space = space[~edge[space] & ~edge[space + 1]]
    before = space - 1
    while len(back := np.flatnonzero(data[before] & 0xC0 == 0x80)):
        before[back] -= 1
    space = space[~(_spaced(data, before) | _spaced(data, space + 1))]
    return np.sort(np.concatenate((offsets[:-1], space)), kind="stable")


def heaps(leaves: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Sums of all nodes of each tree over leaves ``first[i]`` up to ``first[i + 1]``, node 1 the root; trees of one size are built together."""
    counts = np.diff(first)
    sizes = 1 << np.ceil(np.log2(np.maximum(1, counts))).astype(np.int64)
    out: list[list[int]] = [[]] * len(counts)
    for size in np.unique(sizes).tolist():
        trees = np.flatnonzero(sizes == size)
        sums = np.zeros((len(trees), 2 * size), np.int64)
        own = counts[trees]
        tree = np.repeat(np.arange(len(trees)), own)
        leaf = np.arange(len(tree)) - np.repeat(np.cumsum(own) - own, own)
        sums[tree, size + leaf] = leaves[np.repeat(first[trees], own) + leaf]
        level = size
        while level > 1:
            sums[:, level // 2: level] = sums[:, level: 2 * level: 2] + sums[:, level + 1: 2 * level: 2]
            level //= 2
        for t, x in zip(trees.tolist(), sums.tolist(), strict=True):
            out[t] = x
    return out


class TokenTree:
    """Segment tree over the units of one text; ``tokens`` is the count of the whole text as edited so far."""

    def __init__(self, text: str, starts: np.ndarray, characters: list[int], tokens: list[int]):
        """starts: the places in the text where units begin, and its end; characters and tokens: sums of all nodes."""
        self.whole, self.starts, self.changed = text, starts, {}
        self.count, self.size = len(starts) - 1, len(characters) // 2
        self.characters, self.sums = characters, tokens
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _leaf(self, leaf: int) -> str:
        """The leaf's text as edited so far."""
        return self.changed[leaf] if leaf in self.changed else self.whole[self.starts[leaf]: self.starts[leaf + 1]]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` and the place of its first character; the last leaf beyond the end."""
        node, start, characters = 1, 0, self.characters
        while node < self.size:
            left = characters[2 * node]
            node, start = (2 * node, start) if at < start + left else (2 * node + 1, start + left)
        leaf = min(node - self.size, self.count - 1)
        return leaf, start if leaf == node - self.size else characters[1] - characters[self.size + leaf]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        node = self.size + leaf
        longer, more = len(text) - self.characters[node], tokens - self.sums[node]
        self.changed[leaf] = text
        while node:
            self.characters[node] += longer
            self.sums[node] += more
            node //= 2

    def _beside(self, leaf: int, step: int) -> int:
        """The nearest leaf in that direction that is not empty, or ``leaf``."""
        other = leaf + step
        while 0 <= other < self.count:
            if self.characters[self.size + other]:
                return other
            other += step
        return leaf

    def touched(self, start: int, stop: int, text: str) -> tuple[int, int, str]:
        """First and last leaf that replacing characters start..stop by ``text`` may change, and their text after it."""
        total = self.characters[1]
        start = min(max(0, start), total)
        stop = min(max(start, stop), total)
        first, begin = self._find(start)
        last, _ = self._find(max(start, stop - 1))
        low, high = self._beside(first, -1), self._beside(last, 1)
        if low != first:
            begin -= self.characters[self.size + low]
        region = "".join(map(self._leaf, range(low, high + 1)))
        return low, high, region[: start - begin] + text + region[stop - begin:]

    def put(self, low: int, high: int, region: str, tokens: int) -> None:
        """Let the first of these leaves hold the region and the others nothing."""
        self.encoded += len(region)
        for leaf in range(low + 1, high + 1):
            if self.characters[self.size + leaf]:
                self._set(leaf, "", 0)
        self._set(low, region, tokens)


def edit_trees(trees: list[TokenTree], edits: list[list[tuple[int, int, str]]], coder: Encoder) -> None:
    """Apply the edits of each tree in their order; the k-th edits of all trees are encoded in one call."""
    for k in range(max(map(len, edits), default=0)):
        own = [(tree, tree.touched(*e[k])) for tree, e in zip(trees, edits, strict=True) if k < len(e)]
        for (tree, (low, high, region)), ids in zip(own, coder.encode_many([x[2] for _, x in own]), strict=True):
            tree.put(low, high, region, len(ids) // 4)


def _trees(texts: pa.Array, coder: Encoder) -> list[TokenTree]:
    """The tree of each text (a null counts as empty). Arrow numbers the distinct units, and only these are encoded."""
    data, offsets = utf8(texts)
    starts = unit_starts(data, offsets)
    bounds = np.append(starts, len(data))
    # an empty text and the one behind it begin at one place: its unit stands first
    first = np.append(np.searchsorted(starts, offsets[:-1]) + np.arange(len(texts)) - np.searchsorted(offsets[:-1], offsets[:-1]), len(starts))
    units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    tokens = coder.unit_lengths(units.dictionary)[units.indices.to_numpy()]
    places = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))[bounds]
    characters, sums = heaps(np.diff(places), first), heaps(tokens, first)
    return [TokenTree(text or "", places[a: b + 1] - places[a], x, y) for text, a, b, x, y in zip(texts.to_pylist(), first[:-1].tolist(), first[1:].tolist(), characters, sums, strict=True)]


def _edits(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    """The edits of each row in their order."""
    flat = column.flatten()
    edits = list(zip(*(flat.field(k).to_pylist() for k in ("step", "start", "stop", "text")), strict=True))
    ends = np.cumsum([x or 0 for x in column.value_lengths().to_pylist()]).tolist()
    return [[(a, b, t or "") for _, a, b, t in sorted(edits[x:y], key=lambda e: e[0])] for x, y in zip([0, *ends], ends, strict=False)]


def _counted(path: str, lexicon: object) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, lexicon.value)
        for batch in portions(batches, 1):
            trees = _trees(batch.column(1), own)
            before = [t.tokens for t in trees]
            edit_trees(trees, _edits(batch.column(2)), own)
            columns = before, [t.tokens for t in trees], [t.characters[1] for t in trees], [t.encoded for t in trees]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    return counted


def edited_token_counts(docs: DataFrame, path: str, lexicon_words: int = 20_000) -> DataFrame:
    """Rows (doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded), one for each row of ``docs``.

    ``docs``: doc_id, text, edits array<struct<step int, start int, stop int, text string>>; edits apply in
    order of step, each to the text the ones before left, and replace characters start..stop (code points,
    cut to the text's ends). Null texts and null edits count as empty. n_chars_encoded is how many
    characters the edits had encoded again. Repeated rows are counted as often as they come; an empty
    table gives no rows.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(compile_lexicon(path, frequent_words(docs, lexicon_words)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits")
    return rows.mapInArrow(tidy(_counted(path, lexicon), keep=True), "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits for each text, placed by a hash of its doc_id: a word in, a stretch out, a letter over."""
    size = F.coalesce(F.length("text"), F.lit(0))
    place = [F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1).cast("int") for k in range(3)]
    edit = lambda step, start, stop, text: F.struct(
        F.lit(step).alias("step"), start.alias("start"), stop.alias("stop"), F.lit(text).alias("text"))
    return docs.select("doc_id", "text", F.array(
        edit(0, place[0], place[0], " inserted words "), edit(1, place[1], place[1] + 25, ""), edit(2, place[2], place[2] + 1, "é")).alias("edits"))

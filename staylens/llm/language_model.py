"""LM scoring with a log-frequency Bloom filter.

Counts of words, word pairs and triples are quantised in steps of an eighth of a doubling. An n-gram that occurs at
least twice is entered once for each doubling and once for each further eighth, so its count is read back by probing
until a probe fails. The filter is built in parallel, one slice for each range of hashes; every slice is as large as
its entries ask for, so the filter grows with the corpus and its error rate does not. Slices are broadcast while all
of them together stay below a size bound; beyond it they stay where they are and the texts' distinct n-grams are
joined to them. Both ways give the same scores.

A text's probability is the mean of three models: words alone, pairs that back off to words, and triples that back
off to pairs. Discounts and back-off weights come from counts over the whole corpus. A word that the filter does not
hold is spelled by a letter model from a filter of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed, portions, tidy

END = b""
HELD_OUT, FOLDS = 2, 7
FREQUENT = 50_000
PROBES, BITS_AN_ENTRY, STEP, DOUBLINGS = 3, 10, 8, 64
LEAST = 2
SLICES, SLICE_TOKENS, PART_TOKENS, LETTER_SLICES = 256, 8_000_000, 2_000_000, 16
BROADCAST_BYTES = 128 << 20
PAIR, TRIPLE, LETTERS, CONTEXT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LOW = np.uint64(0xFFFFFFFF)
SHARP = 0.97
#: kinds of blobs: the n-grams of the filters, then what else is gathered
WORDS, PAIRS, TRIPLES, FOURS, THREES, COUNTS, FIELD = range(7)
BLOBS = "slice long, kind int, blob binary, bits long, stats array<double>"
#: places in the statistics: tokens, types, tokens of known words, their dequantised sum, tokens that leaving one out makes unknown
TOKENS, TYPES, KNOWN, MASS, FRAGILE = range(5)
#: then for pairs and for triples: how many occur once, twice, three times, LEAST times or more, and the tokens of the last
ORDERS = {PAIRS: 5, TRIPLES: 10}
HISTOGRAM = 15
#: what scoring tells of a text, and, in blob, of the words of a portion of texts whose exact counts are elsewhere
TOLD = "part long, portion long, at int, doc_id long, n_tokens long, known long, base double, score double, blob binary"
SCORED = "doc_id long, n_tokens long, known long, base double, score double"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def before(values: np.ndarray, starts: np.ndarray, steps: int, end: int) -> np.ndarray:
    """The value ``steps`` tokens before each token of texts that begin at ``starts``; ``end`` where the text has not begun."""
    out = np.concatenate((np.full(min(steps, len(values)), end, values.dtype), values[: max(0, len(values) - steps)]))
    for k in range(steps):
        at = starts + k
        limits = np.append(starts[1:], len(values))
        out[at[at < limits]] = end
    return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * PAIR + second)


def triple_keys(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    return mix(mix(first * TRIPLE + second) * PAIR + third)


def letter_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the four-letter sequences of each word between margins, of their three-letter contexts, and how many a word has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b"".join([b"\x00\x00\x00%b\x01" % w for w in words]), np.uint8).astype(np.uint64)
    three = raw[:-3] << np.uint64(16) | raw[1:-2] << np.uint64(8) | raw[2:-1]
    ends = np.cumsum(sizes)
    at = np.repeat(np.arange(len(words)) * 3, sizes) + np.arange(ends[-1] if len(words) else 0)
    three, last = three[at], raw[at + 3]
    return mix((three << np.uint64(8) | last) * LETTERS + np.uint64(1)), mix(three * CONTEXT + np.uint64(2)), sizes


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) if word else 0


class Vocabulary(dict):
    """Small number of each word that a worker has met, and the words' hashes by number."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(word_hash(word))
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts and where each text begins; every text ends in END."""
    flat: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(flat))
        flat += (text or "").encode().lower().split()
        flat.append(END)
    return flat, np.array(starts, np.int64)


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "kind", "blob"])


def _shift(slices: int) -> np.uint64:
    return np.uint64(64 - (slices.bit_length() - 1))


def packed(kind: int, keys: np.ndarray, counts: np.ndarray, slices: int) -> list[tuple[int, int, bytes]]:
    """Distinct sorted keys with counts, one row for each slice of the key space; keys are known by their low 32 bits there."""
    part = (keys >> _shift(slices)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    low, rows = (keys & LOW).astype(np.uint32), []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=False):
        one = counts[a:b] == 1
        some = low[a:b]
        more = some[~one]
        rows.append((int(part[a]), kind, np.array([len(some) - len(more), len(more)], np.uint32).tobytes() + some[one].tobytes() + more.tobytes() + counts[a:b][~one].astype(np.uint32).tobytes()))
    return rows


def summed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of packed blobs of one slice, and their counts."""
    keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for blob in blobs:
        once, more = np.frombuffer(blob, np.uint32, 2).tolist()
        keys.append(np.frombuffer(blob, np.uint32, once + more, 8))
        counts += [np.ones(once, np.int64), np.frombuffer(blob, np.uint32, more, 8 + 4 * (once + more)).astype(np.int64)]
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _count_grams(slices: int) -> Callable:
    """Words with their counts, and keys of pairs and triples, by slice; counted in the task before they are sent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, totals = Vocabulary(), np.zeros(0, np.int64)
        held: dict[int, list[np.ndarray]] = {PAIRS: [], TRIPLES: []}
        size = 0

        def words() -> Iterator[pa.RecordBatch]:
            part = (mix(np.array(vocabulary.hashes, np.uint64)) >> _shift(slices)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))).tolist()
            for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
                some = order[a:b]
                blob = np.array([len(some)], np.uint64).tobytes() + totals[some].astype(np.uint32).tobytes() + b" ".join([vocabulary.words[i] for i in some.tolist()])
                yield _blobs([(int(part[some[0]]), WORDS, blob)])

        def grams() -> Iterator[pa.RecordBatch]:
            for kind, keys in held.items():
                yield _blobs(packed(kind, *np.unique(np.concatenate(keys), return_counts=True), slices))
                keys.clear()

        for batch in portions(batches, 0, 2_000_000):
            flat, starts = tokens(batch.column(0).to_pylist())
            if not flat:
                continue
            numbers = vocabulary.numbers(flat)
            found = np.bincount(numbers, minlength=len(vocabulary.words))
            found[: len(totals)] += totals
            totals = found
            own = np.array(vocabulary.hashes, np.uint64)[numbers]
            one, two = before(own, starts, 1, 0), before(own, starts, 2, 0)
            held[PAIRS].append(pair_keys(one, own))
            held[TRIPLES].append(triple_keys(two, one, own))
            size += len(flat)
            if size > 4_000_000:
                yield from grams()
                size = 0
            if len(vocabulary) > Vocabulary.LIMIT:
                yield from words()
                vocabulary, totals = Vocabulary(), np.zeros(0, np.int64)
        if size:
            yield from grams()
        if len(vocabulary):
            yield from words()

    return count


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of counts from LEAST on: 0 for LEAST itself, STEP more for each doubling."""
    return np.floor(STEP * np.log2(counts / LEAST) + 1e-9).astype(np.int64)


def _seeds(low: np.ndarray, kind: int) -> np.ndarray:
    return low.astype(np.uint64) | np.uint64(kind << 32)


def _slots(seeds: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (n-gram, tag) begin and how far they step, in 32-bit fractions of a slice."""
    h = mix(seeds * np.uint64(2) + np.uint64((2 * tag + 1) * 0x9E3779B1))
    return h & LOW, h >> np.uint64(32) | np.uint64(1)


def filter_slice(grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, int]:
    """The bits of one slice for n-grams (low keys, counts) by kind, and how many they are."""
    seeds, q = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for kind, (low, counts) in grams.items():
        often = counts >= LEAST
        seeds.append(_seeds(low[often], kind))
        q.append(levels(counts[often]))
    seed, level = np.concatenate(seeds), np.concatenate(q)
    chains = level // STEP, level % STEP
    bits = max(64, -(-BITS_AN_ENTRY * int(len(seed) + chains[0].sum() + chains[1].sum()) // 8) * 8)
    field = np.zeros(bits, np.uint8)
    # one chain of tags for doublings from 0 on, one for the eighths beyond from 1 on
    for base, chain, first in ((0, chains[0], 0), (DOUBLINGS, chains[1], 1)):
        for k in range(first, int(chain.max(initial=-1)) + 1):
            at, step = _slots(seed[chain >= k], base + k)
            for i in range(PROBES):
                field[(((at + np.uint64(i) * step) & LOW) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)] = 1
    return np.packbits(field, bitorder="little").tobytes(), bits


class Filter:
    """Read side of a filter: the level of each key, -1 for what was never entered."""

    def __init__(self, fields: dict[int, tuple[bytes, int]], slices: int):
        self.shift = _shift(slices)
        self.bits = np.zeros(slices, np.uint64)
        self.start = np.zeros(slices, np.uint64)
        parts, at = [], 0
        for s in range(slices):
            blob, bits = fields.get(s, (b"\0", 8))
            self.bits[s], self.start[s] = bits, at
            parts.append(blob)
            at += bits
        self.field = np.frombuffer(b"".join(parts), np.uint8)

    def _present(self, seeds: np.ndarray, part: np.ndarray, tag: int) -> np.ndarray:
        at, step = _slots(seeds, tag)
        alive = np.arange(len(seeds))
        for i in range(PROBES):
            home = part[alive]
            place = self.start[home] + (((at[alive] + np.uint64(i) * step[alive]) & LOW) * self.bits[home] >> np.uint64(32))
            alive = alive[(self.field[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return alive

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        seeds = _seeds(keys & LOW, kind)
        part = (keys >> self.shift).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(keys), np.int64)
        high, fine = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        for tag in range(DOUBLINGS):
            at = at[self._present(seeds[at], part[at], tag)]
            if not len(at):
                break
            high[at] = tag
        at = np.flatnonzero(high >= 0)
        for k in range(1, STEP):
            at = at[self._present(seeds[at], part[at], DOUBLINGS + k)]
            if not len(at):
                break
            fine[at] = k
        return np.where(high >= 0, high * STEP + fine, -1)


class Answers:
    """The same read side from levels that were looked up elsewhere for sorted distinct keys of each kind."""

    def __init__(self, known: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.known = known

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        names, found = self.known[kind]
        return found[np.searchsorted(names, keys)]


def _gathered(key: tuple, table: pa.Table) -> pa.Table:
    """One slice: exact word counts, the filter's bits, letter sequences by their own slices, and statistics."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    names: list[bytes] = []
    counts = [np.zeros(0, np.int64)]
    for blob in (b for k, b in zip(kinds, blobs, strict=True) if k == WORDS):
        n = int(np.frombuffer(blob, np.uint64, 1)[0])
        counts.append(np.frombuffer(blob, np.uint32, n, 8).astype(np.int64))
        names += blob[8 + 4 * n:].split(b" ")
    hashes, first, back = np.unique(np.fromiter(map(word_hash, names), np.uint64, len(names)), return_index=True, return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), len(hashes)).astype(np.int64)
    order = np.argsort(mix(hashes) & LOW, kind="stable")
    grams = {WORDS: ((mix(hashes) & LOW)[order], count[order])}
    stats = np.zeros(HISTOGRAM + STEP * DOUBLINGS + 1)
    often = count >= LEAST
    stats[[TOKENS, TYPES, KNOWN, MASS, FRAGILE]] = (
        count.sum(), len(count), count[often].sum(), (2.0 ** (levels(count[often]) / STEP)).sum(), count[count <= LEAST].sum())
    stats[HISTOGRAM:] = np.bincount(1 + np.where(often, levels(np.maximum(LEAST, count)), -1), minlength=STEP * DOUBLINGS + 1)
    for kind, at in ORDERS.items():
        grams[kind] = summed([b for k, b in zip(kinds, blobs, strict=True) if k == kind])
        n = grams[kind][1]
        stats[at: at + 5] = *((n == k).sum() for k in (1, 2, 3)), (n >= LEAST).sum(), n[n >= LEAST].sum()
    field, bits = filter_slice(grams)
    home = key[0].as_py()
    rows = [(home, FIELD, field), (home, COUNTS, hashes.tobytes() + count.tobytes())]
    if names:
        for kind, keys in zip((FOURS, THREES), letter_keys([names[i] for i in first.tolist()])[:2], strict=True):
            rows += packed(kind, *np.unique(keys, return_counts=True), LETTER_SLICES)
    out = pa.Table.from_batches([_blobs(rows)])
    out = out.append_column("bits", pa.array([bits] + [None] * (len(rows) - 1), pa.int64()))
    return out.append_column("stats", pa.array([stats.tolist()] + [None] * (len(rows) - 1), pa.list_(pa.float64())))


def _letters(key: tuple, table: pa.Table) -> pa.Table:
    """One slice of the letters' filter."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    field, bits = filter_slice({kind: summed([b for k, b in zip(kinds, blobs, strict=True) if k == kind]) for kind in (FOURS, THREES)})
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits], pa.int64()), "blob": pa.array([field], pa.binary())})


class Model:
    """What scoring needs besides the n-gram filter; of bounded size."""

    def __init__(self, stats: np.ndarray, letters: Filter, top: tuple[np.ndarray, np.ndarray]):
        """top: sorted hashes of the most frequent words and log10(count + 1) of each."""
        self.letters, self.top = letters, top
        total = max(1.0, stats[TOKENS])
        # leaving one out, a word of count up to LEAST would not have been in the filter
        self.unseen = min(0.9, max(1e-6, stats[FRAGILE] / total))
        self.mass = max(1.0, stats[MASS])
        self.discount, self.back_off = {}, {}
        contexts = {PAIRS: stats[KNOWN], TRIPLES: stats[ORDERS[PAIRS] + 4]}
        for kind, at in ORDERS.items():
            once, twice, thrice, held, running = stats[at: at + 5]
            share = once / (once + 2 * twice) if twice else 1.0
            self.discount[kind] = min(1.5, max(0.1, 2 - 3 * share * thrice / twice)) if twice else 1.0
            spent = (running - self.discount[kind] * held) / max(1.0, contexts[kind])
            self.back_off[kind] = math.log10(min(1.0, max(0.01, 1 - spent)))


class Scorer:
    """Log probabilities of texts; what depends on a word alone is worked out once for each word a worker meets."""

    def __init__(self, grams: Filter | Answers, model: Model):
        self.grams, self.model = grams, model
        self.reset()

    def reset(self) -> None:
        self.vocabulary = Vocabulary()
        self.hashes = np.zeros(0, np.uint64)
        self.own, self.log_single, self.base = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def _learn(self) -> None:
        """Level, log10 of the word's own probability and base logarithm (NaN: not among the frequent) of new words."""
        fresh, model = self.vocabulary.words[len(self.own):], self.model
        hashes = np.array(self.vocabulary.hashes[len(self.own):], np.uint64)
        own = self.grams.level(WORDS, mix(hashes))
        single = math.log10((1 - model.unseen) / model.mass) + own * (math.log10(2) / STEP)
        lost = np.flatnonzero(own < 0)
        if len(lost):
            four, three, sizes = letter_keys([fresh[i] for i in lost.tolist()])
            above, below = (x[0][x[1]] for x in ((model.letters.level(kind, names), back) for kind, (names, back) in (
                (FOURS, np.unique(four, return_inverse=True)), (THREES, np.unique(three, return_inverse=True)))))
            share = np.where((above >= 0) & (below >= 0), np.minimum(1, 2.0 ** ((above - below) / STEP)), 0)
            letters = np.log10(SHARP * share + (1 - SHARP) / 256)
            single[lost] = math.log10(model.unseen) + np.add.reduceat(letters, np.cumsum(sizes) - sizes)
        names, values = model.top
        place = np.minimum(np.searchsorted(names, hashes), max(0, len(names) - 1))
        base = np.where(names[place] == hashes, values[place], np.nan) if len(names) else np.full(len(fresh), np.nan)
        self.hashes, self.own = np.concatenate((self.hashes, hashes)), np.concatenate((self.own, own))
        self.log_single, self.base = np.concatenate((self.log_single, single)), np.concatenate((self.base, base))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.vocabulary) > Vocabulary.LIMIT:
            self.reset()
        out = self.vocabulary.numbers([END, *words])[1:]
        if len(self.own) < len(self.vocabulary.words):
            self._learn()
        return out

    def scores(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each text: the mean over the three models."""
        end = self.vocabulary[END]
        one, two = before(numbers, starts, 1, end), before(numbers, starts, 2, end)
        single = self.log_single[numbers]
        # a held pair has two held words, a held triple two held pairs: only these are probed
        context, known = self.own[one], self.own[numbers]
        pair = np.full(len(numbers), -1, np.int64)
        at = np.flatnonzero((context >= 0) & (known >= 0))
        pair[at] = self.grams.level(PAIRS, pair_keys(self.hashes[one[at]], self.hashes[numbers[at]]))
        log_pair = self._backed(PAIRS, pair, context, single)
        # the pair before: that of the token before, or of two ends at the beginning of a text, which is no pair
        wide = before(pair, starts, 1, -1)
        triple = np.full(len(numbers), -1, np.int64)
        at = np.flatnonzero((wide >= 0) & (pair >= 0))
        triple[at] = self.grams.level(TRIPLES, triple_keys(self.hashes[two[at]], self.hashes[one[at]], self.hashes[numbers[at]]))
        log_triple = self._backed(TRIPLES, triple, wide, log_pair)
        whole = np.stack([np.add.reduceat(x, starts) for x in (single, log_pair, log_triple)])
        most = whole.max(0)
        return most + np.log10((10.0 ** (whole - most)).mean(0))

    def _backed(self, kind: int, level: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 probability by n-grams of this kind where held, else of the lower order, weighed where the context is held."""
        out = lower + np.where(context >= 0, self.model.back_off[kind], 0.0)
        at = np.flatnonzero((level >= 0) & (context >= 0))
        count = LEAST * 2.0 ** (level[at] / STEP)
        out[at] = np.log10(np.minimum(1, (count - self.model.discount[kind]) / (LEAST * 2.0 ** (context[at] / STEP))))
        return out


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _told(scorer: Scorer, batch: pa.RecordBatch, portion: int, shift: int) -> pa.RecordBatch:
    """Figures of each text (doc_id, text) of a portion, and the words whose exact counts are elsewhere by part of the hashes."""
    flat, starts = tokens(batch.column(1).to_pylist())
    numbers = scorer.numbers(flat)
    sizes = np.diff(np.append(starts, len(flat)))
    base = scorer.base[numbers]
    score = scorer.scores(numbers, starts)
    rare = np.flatnonzero(np.isnan(base))
    # each rare word of a text once, with its count
    text_of = np.repeat(np.arange(len(starts)), sizes)[rare]
    pairs, times = np.unique(text_of << 32 | numbers[rare], return_counts=True)
    owner, hashes = pairs >> 32, scorer.hashes[pairs & 0xFFFFFFFF]
    part = (mix(hashes) >> np.uint64(shift)).astype(np.int64)
    order = np.lexsort((owner, part))
    owner, hashes, times, part = owner[order], hashes[order], times[order], part[order]
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    blobs = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=False):
        first = np.flatnonzero(np.concatenate(([True], owner[a + 1: b] != owner[a: b - 1])))
        lengths = np.diff(np.append(first, b - a))
        blobs.append(b"".join((
            np.array([len(first), b - a], np.int64).tobytes(), hashes[a:b].tobytes(), owner[a:b][first].astype(np.uint32).tobytes(),
            lengths.astype(np.uint32).tobytes(), times[a:b].astype(np.uint32).tobytes())))
    n, none = len(starts), [None] * len(blobs)
    return pa.RecordBatch.from_arrays([
        pa.array([int(mix(np.array([portion], np.uint64))[0] >> np.uint64(shift))] * n + part[heads].tolist(), pa.int64()), pa.array([portion] * (n + len(none)), pa.int64()), pa.array([*range(n), *none], pa.int32()),
        pa.concat_arrays([batch.column(0), pa.nulls(len(none), pa.int64())]), pa.array([*sizes.tolist(), *none], pa.int64()),
        pa.array([*np.add.reduceat(~np.isnan(base), starts, dtype=np.int64).tolist(), *none], pa.int64()), pa.array([*np.add.reduceat(np.nan_to_num(base), starts).tolist(), *none], pa.float64()),
        pa.array([*score.tolist(), *none], pa.float64()), pa.array([None] * n + blobs, pa.binary())], _names(TOLD))


def _score(grams: object, model: object, shift: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, first = Scorer(grams.value, model.value), TaskContext.get().partitionId() << 32
        for k, batch in enumerate(portions(batches, 1, 2_000_000)):
            if batch.num_rows:
                yield _told(scorer, batch, first + k, shift)

    return rows


def _asked(texts: list[str | None]) -> dict[int, np.ndarray]:
    """Sorted distinct keys that scoring these texts may look up."""
    flat, starts = tokens(texts)
    vocabulary = Vocabulary()
    numbers = vocabulary.numbers([END, *flat])[1:]
    hashes = np.array(vocabulary.hashes, np.uint64)
    own = hashes[numbers]
    one, two = before(own, starts, 1, 0), before(own, starts, 2, 0)
    return {WORDS: np.unique(mix(hashes)), PAIRS: np.unique(pair_keys(one, own)), TRIPLES: np.unique(triple_keys(two, one, own))}


def _ask(slices: int) -> Callable:
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        rows = []
        for kind, keys in _asked(table.column("text").to_pylist()).items():
            part = (keys >> _shift(slices)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
            rows += [(int(part[a]), kind, keys[a:b].tobytes()) for a, b in zip(heads, [*heads[1:], len(keys)], strict=True)]
        out = pa.Table.from_batches([_blobs(rows)])
        return out.append_column("pack", pa.array([key[0].as_py()] * len(rows), pa.int64()))

    return ask


def _answer(slices: int) -> Callable:
    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        home = (key[0].as_py())
        fields = {home: (held.column("blob")[0].as_py(), held.column("bits")[0].as_py())} if len(held) else {}
        own = Filter({0: fields[home]} if fields else {}, 1)
        found = []
        for kind, blob in zip(asked.column("kind").to_pylist(), asked.column("blob").to_pylist(), strict=True):
            keys = np.frombuffer(blob, np.uint64) & LOW  # the slice is known; what stands above it is not looked at
            found.append(own.level(kind, keys).astype(np.int16).tobytes())
        return pa.table({"pack": asked.column("pack"), "slice": asked.column("slice"), "kind": asked.column("kind"), "blob": pa.array(found, pa.binary())})

    return answer


def _score_pack(model: object, shift: int) -> Callable:
    def score(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        by_kind: dict[int, list[tuple[int, bytes]]] = {WORDS: [], PAIRS: [], TRIPLES: []}
        for home, kind, blob in zip(*(answers.column(c).to_pylist() for c in ("slice", "kind", "blob")), strict=True):
            by_kind[kind].append((home, blob))
        asked = _asked(texts.column("text").to_pylist())
        known = {kind: (asked[kind], np.frombuffer(b"".join(x[1] for x in sorted(parts)), np.int16).astype(np.int64)) for kind, parts in by_kind.items()}
        (batch,) = texts.select(["doc_id", "text"]).to_batches()
        return pa.Table.from_batches([_told(Scorer(Answers(known), model.value), batch, key[0].as_py(), shift)])

    return score


def _resolved(key: tuple, table: pa.Table) -> pa.Table:
    """The texts' own rows as they come; in place of each blob of words, the known tokens and base sums that exact counts give to its texts."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
    names, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob in (b for k, b in zip(kinds, blobs, strict=True) if k == COUNTS):
        n = len(blob) // 16
        names.append(np.frombuffer(blob, np.uint64, n))
        counts.append(np.frombuffer(blob, np.int64, n, 8 * n))
    order = np.argsort(np.concatenate(names), kind="stable")
    # a last name that no word has, so that every word finds a place
    name, count = np.append(np.concatenate(names)[order], np.uint64(2**64 - 1)), np.append(np.concatenate(counts)[order], 0)
    out = []
    for kind, blob in zip(kinds, blobs, strict=True):
        if kind is not None or blob is None:
            out.append(None)
            continue
        texts, n = np.frombuffer(blob, np.int64, 2).tolist()
        hashes = np.frombuffer(blob, np.uint64, n, 16)
        owner, lengths = (np.frombuffer(blob, np.uint32, texts, 16 + 8 * n + 4 * texts * k) for k in (0, 1))
        times = np.frombuffer(blob, np.uint32, n, 16 + 8 * n + 8 * texts).astype(np.int64)
        place = np.searchsorted(name, hashes)
        seen = np.where(name[place] == hashes, count[place], 0)
        heads = np.cumsum(lengths, dtype=np.int64) - lengths
        out.append(owner.tobytes() + np.add.reduceat(np.where(seen > 0, times, 0), heads).tobytes() + np.add.reduceat(times * np.log10(seen + 1.0), heads).tobytes())
    own = table.set_column(table.column_names.index("blob"), "blob", pa.array(out, pa.binary()))
    return own.filter(pa.array([k is None for k in kinds], pa.bool_())).select(_names(TOLD)[1:])


def _closed(key: tuple, table: pa.Table) -> pa.Table:
    """The texts of a portion with all that was found about them."""
    at = table.column("at").to_numpy()
    own = table.filter(pa.array(~np.isnan(at.astype(float)))).sort_by("at")
    known, base = own.column("known").to_numpy().astype(np.int64), own.column("base").to_numpy().astype(float)
    for blob in table.column("blob").to_pylist():
        if blob is not None:
            n = len(blob) // 20
            texts = np.frombuffer(blob, np.uint32, n)
            known[texts] += np.frombuffer(blob[4 * n: 12 * n], np.int64)
            base[texts] += np.frombuffer(blob[12 * n:], np.float64)
    return pa.table({"doc_id": own.column("doc_id"), "n_tokens": own.column("n_tokens"), "known": pa.array(known), "base": pa.array(base), "score": own.column("score")})


def _frequent(least: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                n = len(blob) // 16
                names, counts = np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n)
                often = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(names[often]), pa.array(counts[often])], ["h", "n"])

    return rows


def _power(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def train_and_score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, frequent: int = FREQUENT, pack_bytes: int = 4_000_000) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id counts as a training row).
    Null and empty texts hold one token, the end. Repeated rows are scored as often as they come. With no
    training row at all N and V are 0 and every word is unseen. An empty table gives no rows. Other columns
    are not looked at. ``docs`` gives its rows in one order whenever it is read, as tables do.

    Word counts for the base score are exact (words are known by 64-bit hashes): those of at most ``frequent``
    frequent words are broadcast, all others are joined. The filter holds every word, pair and triple that occurs
    at least twice, at every size of the corpus. It is broadcast if it takes at most ``broadcast_bytes``; if not,
    its slices are joined to the n-grams of packs of about ``pack_bytes`` bytes of texts, with the same result.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(SLICES, _power(size / 6 / SLICE_TOKENS))
    parts = min(slices, max(16, _power(size / 6 / PART_TOKENS)))
    grams = rows.filter(~held).select("text").mapInArrow(tidy(_count_grams(slices)), "slice long, kind int, blob binary")
    gathered = checkpointed(grams.groupBy("slice").applyInArrow(_gathered, BLOBS))
    stats = np.zeros(HISTOGRAM + STEP * DOUBLINGS + 1)
    for r in gathered.filter("stats IS NOT NULL").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        stats[r["at"]] = r["x"]
    # the least level at which no more than ``frequent`` words remain; the first place counts words below LEAST
    remaining = np.cumsum(stats[HISTOGRAM:][::-1])[::-1]
    enough = np.flatnonzero(remaining <= frequent)
    low = int(enough[0]) - 1 if len(enough) else STEP * DOUBLINGS
    least = 1 if low < 0 else math.ceil(LEAST * 2 ** (low / STEP) - 1e-6)
    top = gathered.filter(F.col("kind") == COUNTS).select("blob").mapInArrow(_frequent(least), "h long, n long").toArrow()
    names = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    letters = gathered.filter(F.col("kind").isin(FOURS, THREES)).groupBy("slice").applyInArrow(_letters, "slice long, bits long, blob binary").collect()
    shared = context.broadcast(Model(
        stats, Filter({r["slice"]: (bytes(r["blob"]), r["bits"]) for r in letters}, LETTER_SLICES), (names[order], np.log10(top["n"].to_numpy().astype(float)[order] + 1))))
    fields = gathered.filter(F.col("kind") == FIELD).select("slice", "bits", "blob")
    shift = 64 - (parts.bit_length() - 1)
    if (fields.agg(F.sum("bits")).first()[0] or 0) <= 8 * broadcast_bytes:
        whole = context.broadcast(Filter({r["slice"]: (bytes(r["blob"]), r["bits"]) for r in fields.collect()}, slices))
        told = rows.mapInArrow(tidy(_score(whole, shared, shift)), TOLD)
    else:
        packs = max(1, -(-size // pack_bytes))
        laid = checkpointed(rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs))))
        asked = laid.groupBy("pack").applyInArrow(_ask(slices), "slice long, kind int, blob binary, pack long")
        answers = asked.groupBy("slice").cogroup(fields.groupBy("slice")).applyInArrow(_answer(slices), "pack long, slice long, kind int, blob binary")
        told = laid.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_score_pack(shared, shift), TOLD)
    total, types = int(stats[TOKENS]), int(stats[TYPES])
    absent = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in TOLD.split(", ")[1:-1]]
    counts = gathered.filter(F.col("kind") == COUNTS).select(F.expr(f"slice div {slices // parts}").alias("part"), "kind", "blob", *absent)
    resolved = told.withColumn("kind", F.lit(None).cast("int")).select(*counts.columns).unionByName(counts).groupBy("part").applyInArrow(_resolved, TOLD.split(", ", 1)[1])
    return resolved.groupBy("portion").applyInArrow(_closed, SCORED).select(
        "doc_id", held.alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + types + 1))).alias("base_score"), "score")

"""Exact BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are compiled, with their token ids as outputs, into a minimal automaton in which words
share suffixes as well as prefixes. Outputs lie on the arcs: the sum along a word's path is its number in
sorted order, which addresses its ids. The automaton is one flat buffer that workers map into memory.
Words that it does not hold are merged exactly, pair by pair in order of rank, so the lexicon's contents
change the speed and never the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import CACHES, portions, tidy, utf8

NONE = 1 << 62
#: fixed values: the pre-token patterns that the two vocabularies' files name
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: white space of str.split() that the vocabularies do not count as white space
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: kinds of bytes: 1 letters, 2 digits, 3 others; 4 white space, apostrophes and what is not ASCII, whose pre-tokens need the pattern
KINDS = np.array([4 if b > 127 or chr(b).isspace() or b == 39 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: all other white space but the space
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in ODD_SPACE + " "]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Lexicon:
    """Minimal acyclic transducer from words (bytes) to id sequences, in one buffer."""

    def __init__(self, buffer: np.ndarray):
        """buffer: int64 header (arcs, words, ids), then keys, targets, outputs, final flags, starts, ids as int32/int64."""
        arcs, states, words, ids = np.frombuffer(buffer, np.int64, 4)
        at = 32

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(buffer, kind, int(n), at)
            at += part.nbytes
            return part

        self.keys, self.starts = take(np.int64, arcs), take(np.int64, words + 1)
        self.targets, self.outputs, self.ids, self.final = take(np.int32, arcs), take(np.int32, arcs), take(np.uint32, ids), take(np.uint8, states)

    @staticmethod
    def build(entries: dict[bytes, list[int]]) -> bytes:
        """Compile words to ids: incremental minimisation over the sorted words."""
        words = sorted(w for w in entries if w)
        children: list[dict[int, int]] = [{}]
        final = [0]
        register: dict[tuple, int] = {}
        path: list[int] = [0]

        def settle(word: bytes, down_to: int) -> None:
            for depth in range(len(path) - 1, down_to, -1):
                state, parent = path.pop(), path[-1] if depth else 0
                key = (final[state], *children[state].items())
                parent = path[-1]
                if key in register:
                    children[parent][word[depth - 1]] = register[key]
                else:
                    register[key] = state

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            settle(last, common)
            for byte in word[common:]:
                children.append({})
                final.append(0)
                children[path[-1]][byte] = len(children) - 1
                path.append(len(children) - 1)
            final[path[-1]] = 1
            last = word
        settle(last, 0)
        live, order, stack = {0: 0}, [], [0]
        while stack:
            state = stack.pop()
            order.append(state)
            for child in children[state].values():
                if child not in live:
                    live[child] = len(live)
                    stack.append(child)
        size: dict[int, int] = {}

        def count(top: int) -> int:
            todo = [top]
            while todo:
                state = todo[-1]
                missing = [c for c in children[state].values() if c not in size]
                if missing:
                    todo += missing
                else:
                    size[state] = final[state] + sum(size[c] for c in children[state].values())
                    todo.pop()
            return size[top]

        count(0)
        keys, targets, outputs = [], [], []
        for state in order:
            before = final[state]
            for byte, child in sorted(children[state].items()):
                keys.append(live[state] << 8 | byte)
                targets.append(live[child])
                outputs.append(before)
                before += size[child]
        rank = np.argsort(np.array(keys, np.int64), kind="stable")
        ends = np.zeros(len(live), np.uint8)
        for state in order:
            ends[live[state]] = final[state]
        ids = [entries[w] for w in words]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        flat = np.array([i for x in ids for i in x], np.uint32)
        return b"".join(x.tobytes() for x in (
            np.array([len(keys), len(live), len(words), len(flat)], np.int64), np.array(keys, np.int64)[rank], starts.astype(np.int64),
            np.array(targets, np.int32)[rank], np.array(outputs, np.int32)[rank], flat, ends))

    @classmethod
    def mapped(cls, content: bytes) -> Lexicon:
        """Put the buffer into an unnamed file of this worker and map it."""
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            return cls(np.memmap(file, np.uint8, "r"))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words walk the automaton in step, longest first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return self.find_at(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def find_at(self, text: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of the word at each place of the text, or -1."""
        number = np.zeros(len(lengths), np.int64)
        state = np.zeros(len(lengths), np.int64)
        if len(self.keys) == 0:
            return np.full(len(lengths), -1, np.int64)
        active = np.argsort(-lengths, kind="stable")
        depth = 0
        while True:
            active = active[lengths[active] > depth]
            if not len(active):
                break
            key = state[active] << 8 | text[begin[active] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[active[~hit]] = -1
            active, arc = active[hit], arc[hit]
            number[active] += self.outputs[arc]
            state[active] = self.targets[arc]
            depth += 1
        good = (state >= 0) & (lengths > 0)
        good[good] = self.final[state[good]] == 1
        return np.where(good, number, -1)


class Encoder:
    """Token ids of texts for a byte-level or word-end BPE vocabulary file, as little-endian uint32 bytes."""

    CHUNKS, WORDS = 200_000, 100_000

    def __init__(self, path: str, lexicon: bytes | None = None):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + self.suffix] for x in letters]
        self.pairs: dict[int, int] = {}
        self.sides: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocab[a], vocab[b]
            merged = rank << 17 | vocab[a + b]
            self.pairs[left << 17 | right] = merged
            self.sides[merged] = (left, right)
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.slot_keys, self.slot_values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        self.probes = 0
        todo = np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int64)
        while len(todo[0]):  # open addressing: all pairs that found their slot taken try the next one
            slot = self._slots(todo[0], self.probes)
            _, first = np.unique(slot, return_index=True)
            first = first[self.slot_keys[slot[first]] < 0]
            self.slot_keys[slot[first]], self.slot_values[slot[first]] = todo[0][first], todo[1][first]
            rest = np.ones(len(slot), bool)
            rest[first] = False
            todo = todo[0][rest], todo[1][rest]
            self.probes += 1
        self.first_ids, self.last_ids = np.array(self.first, np.int64), np.array(self.last, np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(WORD_END if self.suffix else BYTE_LEVEL)
        self.lines = regex.compile(WORD_END + r"|\n")
        back = {x: b for b, x in enumerate(letters)}
        self.spelled: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.spelled[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merges of one pre-token."""
        if not word:
            return []
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > 80:
            return self._merge_long(ids)
        get, sides = self.pairs.get, self.sides
        while len(ids) > 1:
            best = NONE
            left = ids[0]
            for right in ids[1:]:
                found = get(left << 17 | right, NONE)
                if found < best:
                    best = found
                left = right
            if best == NONE:
                break
            a, b = sides[best]
            out, i, n, merged = [], 0, len(ids), best & 0x1FFFF
            while i < n:
                if i + 1 < n and ids[i] == a and ids[i + 1] == b:
                    out.append(merged)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap over a linked list: n log n for words of any length."""
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        heap = [(found, i) for i in range(n - 1) if (found := get(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            found, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 17 | ids[j]) != found:
                continue
            ids[i], ids[j] = found & 0x1FFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := get(ids[i] << 17 | ids[k])) is not None:
                    heapq.heappush(heap, (new, i))
            if (h := before[i]) >= 0 and (new := get(ids[h] << 17 | ids[i])) is not None:
                heapq.heappush(heap, (new, h))
        return [i for i in ids if i >= 0]

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        return (mixed.astype(np.int64) + probe) & (len(self.slot_keys) - 1)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """rank and merged id of each pair of neighbours, NONE where they never merge."""
        slot = self._slots(keys, 0)
        found = np.where(self.slot_keys[slot] == keys, self.slot_values[slot], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.slot_keys[slot] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = (slot[open_] + 1 if probe == 1 else slot + 1) & (len(self.slot_keys) - 1)
            hit = self.slot_keys[slot] == keys[open_]
            found[open_[hit]] = self.slot_values[slot[hit]]
            going = ~hit & (self.slot_keys[slot] >= 0)
            open_, slot = open_[going], slot[going]
        return found

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as bytes: in each round every word merges its pair of lowest rank."""
        out = [b""] * len(words)
        own = []
        for i, word in enumerate(words):
            if len(word) > 80:
                out[i] = np.array(self.merge(word), np.uint32).tobytes()
            elif word:
                own.append(i)
        if not own:
            return out
        sizes = np.fromiter((len(words[i]) for i in own), np.int64, len(own))
        for names, ids, starts, stops in self._merged(np.frombuffer(b"".join([words[i] for i in own]), np.uint8), sizes):
            flat = ids.astype(np.uint32).tobytes()
            for k, a, b in zip(names.tolist(), (4 * starts).tolist(), (4 * stops).tolist(), strict=True):
                out[own[k]] = flat[a:b]
        return out

    def _merged(self, raw: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rounds of merges of words that follow each other; a round gives the words it ended: their numbers, and ids with first and last places."""
        ids = self.first_ids[raw]
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last_ids[raw[ends - 1]]
        names = np.arange(len(sizes))
        word = np.repeat(names, sizes)
        while len(ids):
            rank = np.full(len(ids), NONE, np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self._ranks(ids[inside] << 17 | ids[inside + 1])
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                stops = np.append(starts[1:], len(ids))
                yield names[done], ids, starts[done], stops[done]
                lengths = stops - starts
                keep = np.repeat(~done, lengths)
                ids, rank = ids[keep], rank[keep]
                names, best, lengths = names[~done], best[~done], lengths[~done]
                word = np.repeat(np.arange(len(names)), lengths)
            if not len(ids):
                break
            hit = rank == best[word]
            # of equal neighbours (a a a) the left pair merges first: every second hit of a run counts
            chained = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(chained):
                for i in chained.tolist():
                    hit[i] = hit[i] and not hit[i - 1]
            at = np.flatnonzero(hit)
            ids[at] = rank[at] & 0x1FFFF
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]

    def _normal(self, chunk: str) -> str:
        """What the word-end vocabulary does to a text before it is cut."""
        if chunk.isascii():
            return chunk.lower()
        composed = unicodedata.normalize("NFC", chunk)
        return composed.replace("Σ", "σ").lower()  # no form of its own at a word's end

    def pretokens(self, chunk: str) -> list[str]:
        if self.suffix:
            chunk = self._normal(chunk)
            if chunk.isalpha():
                return [chunk]
        elif chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        return self.pattern.findall(chunk)

    def learn(self, words: set[str]) -> list[str]:
        """Put the ids of new pre-tokens into the cache, from the transducer or by merging; returns what is new."""
        fresh = list(words.difference(self.words))
        raw = [w.encode() for w in fresh]
        numbers = self.lexicon.find(raw).tolist() if self.lexicon and fresh else [-1] * len(fresh)
        missing = []
        for word, number in zip(fresh, numbers, strict=True):
            if number >= 0:
                starts = self.lexicon.starts
                self.words[word] = self.lexicon.ids[starts[number]: starts[number + 1]].tobytes()
            else:
                missing.append(word)
        for at in range(0, len(missing), 50_000):
            some = missing[at: at + 50_000]
            self.words.update(zip(some, self.merge_many([w.encode() for w in some]), strict=True))
        return fresh

    def _pieces(self, text: str) -> list[str]:
        """The text cut where pre-tokens of both sides cannot depend on each other."""
        if self.suffix:
            return [text] if any(c in text for c in ODD_SPACE) else text.split()
        # beside a space another white-space character: there the text cannot be cut at the space alone
        if "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACE):
            return [text]
        head, *rest = text.split(" ")
        return [head, *map(" ".__add__, rest)]

    def _meet(self, fresh: set) -> list[str]:
        """Put the ids of new chunks into the cache; returns the pre-tokens that were new."""
        single: dict[str, str] = {}
        several: dict[str, list[str]] = {}
        for chunk in fresh:
            if not isinstance(chunk, str):
                self.chunks[chunk] = chunk[0].to_bytes(4, "little")
            elif self.suffix and (word := chunk.lower() if chunk.isascii() else self._normal(chunk)).isalpha():
                single[chunk] = word
            elif len(found := self.pretokens(chunk)) == 1:
                single[chunk] = found[0]
            else:
                several[chunk] = found
        new_words = self.learn(set(single.values()).union(*several.values()))
        words = self.words
        self.chunks.update(zip(single, map(words.__getitem__, single.values()), strict=True))
        for chunk, found in several.items():
            self.chunks[chunk] = b"".join(map(words.__getitem__, found))
        return new_words

    def _shrink(self, fresh: set, new_words: list[str]) -> None:
        """Chunks and words first met stay cached until the caches are full."""
        for cache, size, new in ((self.chunks, self.CHUNKS, fresh), (self.words, self.WORDS, new_words)):
            over = len(cache) - size
            for x in new:
                if over > 0 or len(x) > 64:
                    del cache[x]
                    over -= 1

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text; special tokens' strings become their ids."""
        cut: list[list] = []
        for text in texts:
            if self.cut and "<|" in text:
                cut.append([c for k, x in enumerate(self.cut.split(text)) for c in ([(self.special[x],)] if k % 2 else self._pieces(x))])
            else:
                cut.append(self._pieces(text))
        fresh = set().union(*cut).difference(self.chunks)
        new_words = self._meet(fresh)
        out = [b"".join(map(self.chunks.__getitem__, p)) for p in cut]
        self._shrink(fresh, new_words)
        return out

    def _spelled(self, chunks: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of chunks without line ends, cut into pre-tokens in one pass, and the pre-tokens that were new; word-end vocabularies only."""
        found = self.lines.findall(self._normal("\n".join(chunks)))
        new_words = self.learn(set(found).difference("\n"))
        ids = list(map(self.words.get, found))  # none for a line end
        breaks = [k for k, x in enumerate(ids) if x is None]
        for k in breaks:
            ids[k] = b""
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        breaks = ends[breaks].tolist()
        flat = b"".join(ids)
        return [flat[a:b] for a, b in zip([0, *breaks], [*breaks, len(flat)], strict=True)], new_words

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls and special tokens) one after another, and how many each has; word-end vocabularies only.

        White space of ASCII always parts pre-tokens, so Arrow cuts the texts there and numbers their distinct chunks; only these are
        looked up, and their ids are copied to all places at once.
        """
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.chunks.get, chunks))
        fresh = [k for k, x in enumerate(known) if x is None]
        places = coded.indices.to_numpy()
        if fresh:
            often = (np.bincount(places, minlength=len(chunks))[fresh] > 1).tolist()
            names = [chunks[k] for k in fresh]
            ids, new_words = self._spelled(names)
            for k, x in zip(fresh, ids, strict=True):
                known[k] = x
            free = max(0, self.CHUNKS - len(self.chunks))
            self.chunks.update([(c, x) for c, x, many in zip(names, ids, often, strict=True) if many and len(c) <= 64][:free])
            self._shrink(set(), new_words)
        flat = np.frombuffer(b"".join(known), np.uint32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        counts = sizes[places]
        ends = np.cumsum(counts)
        shift = (np.cumsum(sizes) - sizes)[places] - (ends - counts)
        out = flat[np.repeat(shift, counts) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return out, np.diff(upto)

    def chunk_lengths(self, chunks: list[str]) -> list[int]:
        """How many ids each of these distinct chunks has: texts that need no more cutting, such as a word with the space before it."""
        known = list(map(self.chunks.get, chunks))
        fresh = [k for k, x in enumerate(known) if x is None]
        special = [k for k in fresh if "<|" in chunks[k]] if self.cut else []
        if special:
            for k, x in zip(special, self.encode_many([chunks[k] for k in special]), strict=True):
                known[k] = x
            fresh = [k for k in fresh if known[k] is None]
        names = {chunks[k] for k in fresh}
        new_words = self._meet(names)
        for k in fresh:
            known[k] = self.chunks[chunks[k]]
        self._shrink(names, new_words)
        return [len(x) // 4 for x in known]

    def unit_lengths(self, units: pa.Array) -> np.ndarray:
        """What ``chunk_lengths`` gives for distinct units (large strings); byte-level vocabularies only.

        Units of ASCII words with at most a space before them are cut where letters, digits and others meet, and the distinct
        pre-tokens of all of them are looked up and merged as arrays; other units are met one by one.
        """
        n = len(units)
        data, offsets = utf8(units)
        if not len(data):
            return np.zeros(n, np.int64)
        kind = KINDS[data]
        lengths = np.diff(offsets)
        start = offsets[:-1][lengths > 1]
        start = start[data[start] == 32]
        kind[start] = 0  # a space before the unit's first character goes with it
        odd = np.flatnonzero(kind == 4)
        if self.cut:
            odd = np.concatenate((odd, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))))
        slow = lengths == 0
        slow[np.searchsorted(offsets, odd, "right") - 1] = True
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        new[offsets[:-1][lengths > 0]] = True
        begin = np.flatnonzero(new)
        owner = np.searchsorted(offsets, begin, "right") - 1
        fast = ~slow[owner]
        size = np.diff(np.append(begin, len(data)))[fast]
        begin, owner = begin[fast], owner[fast]
        raw = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(raw)]).dictionary_encode()
        counts = self._word_lengths(*utf8(words.dictionary)) if len(size) else np.zeros(0, np.int64)
        out = np.bincount(owner, counts[words.indices.to_numpy()], n).astype(np.int64)
        slow = np.flatnonzero(slow)
        out[slow] = self.chunk_lengths(units.take(pa.array(slow)).to_pylist())
        return out

    def _word_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each pre-token has, from the transducer or by merging."""
        size, begin = np.diff(offsets), offsets[:-1]
        number = self.lexicon.find_at(data, begin, size) if self.lexicon else np.full(len(size), -1)
        out = np.diff(self.lexicon.starts)[np.maximum(number, 0)] if self.lexicon and len(self.lexicon.starts) > 1 else np.zeros(len(size), np.int64)
        for k in np.flatnonzero((number < 0) & (size > 80)).tolist():
            out[k] = len(self.merge(data[offsets[k]: offsets[k + 1]].tobytes()))
        own = np.flatnonzero((number < 0) & (size <= 80))
        for at in range(0, len(own), 50_000):
            some = own[at: at + 50_000]
            raw = data[np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())]
            for names, _, starts, stops in self._merged(raw, size[some]):
                out[some[names]] = stops - starts
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}
CACHES.append(_encoders)


def encoder(path: str, lexicon: bytes | None = None) -> Encoder:
    """This worker's encoder; one is kept for each vocabulary and lexicon."""
    key = path, hashlib.md5(lexicon or b"").digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, lexicon)
    return _encoders[key]


def _count_chunks(share: float) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update((text or "").split())
            least = max(2, share * seen.total())
            kept = {w: n for w, n in seen.items() if n >= least and len(w) < 40}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    return count


def frequent_words(docs: DataFrame, size: int = 20_000, share: float = 1e-5) -> list[str]:
    """The ``size`` most frequent white-space separated words of all texts (a bounded list).

    A word enters where it makes up at least ``share`` of a portion's words; a word of that share of the
    whole corpus does so in some portion, so rare words are never shuffled.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(_count_chunks(share)), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in top.collect()]


def compile_lexicon(path: str, words: Iterable[str]) -> bytes:
    """The transducer of these words as the vocabulary spells them inside a text."""
    own = Encoder(path)
    spelled = {w for x in words for form in ((x,) if own.suffix else (x, " " + x)) for w in own.pretokens(form)}
    return Lexicon.build({w.encode(): own.merge(w.encode()) for w in spelled})


def _digests(path: str, lexicon: object) -> Callable:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, lexicon.value)
        for batch in portions(batches, 1, 2_000_000):
            ids = own.encode_many([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(np.frombuffer(x, np.uint32)) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"])

    return digest


def encode_decode(docs: DataFrame, path: str, lexicon_words: int = 20_000) -> DataFrame:
    """Rows (doc_id, ids binary: little-endian uint32, decoded string), one for each input row.

    ``path``: a byte-level or word-end BPE vocabulary file that every worker can read. A null text counts
    as empty and has no ids. doc_id may be null or repeat; other columns are not looked at. The lexicon
    (at most ``lexicon_words`` words, a few MB) is the only thing broadcast.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(compile_lexicon(path, frequent_words(docs, lexicon_words)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_digests(path, lexicon), keep=True), "doc_id long, ids binary, decoded string")

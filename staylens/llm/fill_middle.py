"""Fill-in-the-middle transformation, with cuts found by rank and select over packed boundary bits.

The ends of tokens are bits over the bytes of many texts, packed into words, with the number of ends before each block
in a directory. The ends inside a text are a difference of two ranks, and a cut after k tokens is a select.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import utf8

#: fixed values: the white space between tokens and the markers of the output
WHITE = [0x20, *range(0x09, 0x0E)]
MARKERS = "<P>", "<S>", "<M>"
#: bytes of text whose bits stand in memory at once; a longer text goes alone
PORTION = 4_000_000
IS_WHITE = np.isin(np.arange(256), WHITE)


class Bits:
    """A packed bitvector with a directory of the ones before each block of 512 bits."""

    WORDS = 8

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros(-(-max(len(packed), 1) // (8 * self.WORDS)) * 8 * self.WORDS, np.uint8)
        room[: len(packed)] = packed
        self.blocks = room.view("<u8").reshape(-1, self.WORDS)
        self.counts = np.bitwise_count(self.blocks)
        self.before = np.concatenate(([0], np.cumsum(self.counts.sum(1, dtype=np.int64))))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        places = np.asarray(places, np.int64)
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        block = np.minimum(word // self.WORDS, len(self.blocks) - 1)
        inside = word - block * self.WORDS  # WORDS for the place behind all bits
        whole = (self.counts[block] * (np.arange(self.WORDS) < inside[:, None])).sum(1, dtype=np.int64)
        last = self.blocks[block, np.minimum(inside, self.WORDS - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.where(inside < self.WORDS, np.bitwise_count(last), 0)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Place of the one that has so many ones before it."""
        ranks = np.asarray(ranks, np.int64)
        block = np.searchsorted(self.before, ranks, "right") - 1
        left = ranks - self.before[block]
        upto = np.cumsum(self.counts[block], 1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(1)
        left -= np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        spread = np.unpackbits(np.ascontiguousarray(self.blocks[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = np.argmax(np.cumsum(spread, 1, dtype=np.uint8) == (left + 1)[:, None], 1)
        return (block * self.WORDS + word) * 64 + bit


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at each byte that ends a token: leading white space with a word, or white space at a text's end."""
    white = IS_WHITE[data]
    ends = np.ones(len(data), bool)
    ends[:-1] = ~white[:-1] & white[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return ends


def find_cuts(texts: pa.Array, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens n of each text, and the bytes before the first and the second cut: draws modulo n + 1 tokens, in order."""
    data, offsets = utf8(texts)
    bits = Bits(token_ends(data, offsets))
    base = bits.rank(offsets)
    n = np.diff(base)
    drawn = np.sort(np.stack([one % (n + 1), other % (n + 1)]), 0)
    cuts = []
    for k in drawn:
        cut = np.zeros(len(n), np.int64)
        some = np.flatnonzero(k)
        cut[some] = bits.select(base[some] + k[some] - 1) + 1 - offsets[some]
        cuts.append(cut)
    return n, *cuts


CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def _cut(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    _, offsets = utf8(texts)
    found, start = [], 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PORTION, "right")) - 1)
        some = slice(start, stop)
        found.append(find_cuts(texts[some], one[some].to_numpy(zero_copy_only=False), other[some].to_numpy(zero_copy_only=False)))
        start = stop
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], fields=list(CUTS))


def drawn(doc_id: Column, group: int, seed: int) -> Column:
    """The group-th (from 0) eight hexadecimal digits of the SHA-256 of ``seed:doc_id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80) -> DataFrame:
    """Rows (doc_id, n long, form string, prefix_chars long, middle_chars long, output string), one for each input row.

    Of all texts ``percent`` in a hundred are cut at two token boundaries that doc_id draws, and of these ``suffix_first``
    in a hundred begin with the suffix (form ``spm``), the others with the prefix (``psm``). A text that is null, empty or
    holds a marker stays as it is (``plain``; a null one becomes empty), with null counts. Rows with one doc_id draw alike;
    rows without one draw as the empty id. An empty table gives no rows; other columns are not looked at. A text of any
    length is cut whole; its bits take an eighth of its bytes and the directory an eightieth.
    """
    # imported here: the decorator asks for a session's types
    from pyspark.sql.functions import arrow_udf

    cut = arrow_udf(_cut, "n long, first long, second long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    draws = [drawn(F.col("doc_id"), g, seed) for g in range(4)]
    rows = rows.withColumn("cut", cut(F.col("text"), draws[0], draws[1]))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (draws[2] % 100 >= percent)
    form = F.when(plain, "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")
    raw, first, second = F.col("text").cast("binary"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring(raw, F.lit(1), first).cast("string"), F.substring(raw, first + 1, second - first).cast("string")
    suffix = F.substring(raw, second + 1, F.octet_length(raw)).cast("string")
    p, s, m = map(F.lit, MARKERS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return rows.withColumn("form", form).select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(F.col("form") != "plain", F.length(prefix)).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.length(middle)).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Parts of cut texts hold no marker, so markers part them."""
    parts = F.split(output, "|".join(MARKERS), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))

"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits. It is cut into two 32-bit segments; of two fingerprints at most ``radius`` = 2
bits apart, one segment differs in at most one bit. Each distinct fingerprint enumerates the ball of
radius 1 around each of its segments (33 keys), fetches the fingerprints filed under those keys and
verifies the complete distance. Copies share a fingerprint and are looked up once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed, connected_components, portions

SEGMENT_BITS = 32


def _batch_fingerprints(words: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in portions(batches, 1, 2_000_000):
            hashes: list[int] = []
            counts = []
            for text in batch.column(1).to_pylist():
                before = len(hashes)
                # bytes.split() cuts at exactly space and \x09-\x0d; bytes.lower() touches A-Z only
                tokens = (text or "").encode().lower().split()
                if tokens:
                    line = b" ".join(tokens)
                    if len(tokens) <= words:
                        hashes.append(digest(line, seed))
                    else:
                        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
                        starts = np.concatenate(([0], ends[:-1] + 1))
                        hashes += [digest(line[a:b], seed) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)]
                counts.append(len(hashes) - before)
            sizes = np.array(counts, np.int64)
            votes = np.zeros((len(sizes), 64), np.int64)
            filled = np.flatnonzero(sizes)
            if len(filled):
                values = np.array(hashes, np.uint64)
                ends = np.cumsum(sizes)
                for i in filled:  # one sum per document keeps the unpacked bits small
                    own = values[ends[i] - sizes[i]: ends[i]]
                    for at in range(0, len(own), 65_536):
                        bits = np.unpackbits(own[at: at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        votes[i] += bits.sum(axis=0, dtype=np.int64)
            set_bits = (2 * votes > sizes[:, None]).astype(np.uint8)
            prints = np.packbits(set_bits, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], ["doc_id", "text_key", "fp"])

    return fingerprint


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, text_key, fp long) of whole texts, one per input row; a text without words gets zero, text_key is xxhash64 of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(
        _batch_fingerprints(words, seed), "doc_id long, text_key long, fp long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that differ in one or two bits, a < b.

    Rows grow as 66 keys a distinct fingerprint; a fingerprint has at most 2,080 others within two bits,
    so links cannot grow with the square of a group of copies. Both sides are shuffled: Spark reckons exploded
    rows as no larger than what they come from and would send all keys through the driver.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS).bitwiseOR(F.lit(1 << SEGMENT_BITS))  # its own key space
    filed = prints.select(F.col("fp").alias("a"), F.explode(F.array(low, high)).alias("key"))
    masks = F.array(*[F.lit(m).cast("long") for m in [0] + [1 << i for i in range(SEGMENT_BITS)]])
    probes = (
        prints.select(F.col("fp").alias("b"), F.explode(F.array(low, high)).alias("segment"))
        .select("b", F.explode(F.transform(masks, lambda m: F.col("segment").bitwiseXOR(m))).alias("key"))
    )
    return filed.join(probes.hint("merge"), "key").filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b").distinct()


def _in_components(prints: DataFrame) -> DataFrame:
    """``prints`` with component, the name of each fingerprint's component, and component_id, the smallest doc_id in it."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = fingerprint_links(distinct.select("fp"))
    of_print = connected_components(links)
    named = (
        distinct.join(of_print.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component", "component_id")
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each input row.

    component_id is the smallest doc_id reachable over fingerprints at most two bits apart. Null and
    empty texts have fingerprint zero and link like any other. A row whose doc_id is null keeps its place
    in a component but never names it. Repeated rows stay repeated; an empty table gives no rows. Columns
    of ``docs`` other than doc_id and text are not looked at.
    """
    prints = checkpointed(fingerprints(docs, words, seed).drop("text_key"))
    return _in_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def components(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, text_key, component), one for each row with a doc_id; component names what fingerprints at most two bits apart connect.

    Different texts under one doc_id each have their own component. Awkward rows are treated as in ``near_duplicates``.
    """
    prints = checkpointed(fingerprints(docs.filter("doc_id IS NOT NULL"), words, seed))
    return _in_components(prints).select("doc_id", "text_key", "component")

"""The registered queries themselves, with their digest columns, against plain computations on the smallest tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from staylens.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


def rows_of(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


def test_shards_of_the_query(spark, texts):
    rows = rows_of(spark, "op2_sharding")
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(shards[k]) for k in range(24)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_repeats_of_the_query(spark, texts):
    seen, wanted = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            window = raw[s: s + 100]
            if window in seen:
                gone[s: s + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(b and not a for a, b in zip(b"\0" + bytes(gone), gone))
        wanted[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, "op1_suffix_dedup")} == wanted


def test_ids_of_the_queries(spark, texts):
    byte = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows_of(spark, "op5_bpe"):
        ids = byte.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    word = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows_of(spark, "op3_packing"):
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = np.array([*word.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [r.start for r in own] == list(range(0, len(ids), 2_048)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes()) for r in own)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2_048

"""Filter audit, fill-in-the-middle and piece encoding against brute force, the library and SQL."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from staylens.llm import fill_middle, filter_audit, pieces, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

SCHEMA = "doc_id long, text string, lang string, part string, n long, mask int, form string, output string, chunk string, cut int"
LONG = " ".join(f"word{i} Is\there" for i in range(60_000))
TEXTS = [
    "", None, " ", "\t\n ", "a", " a", "a ", "  a  b  ", "one <P> two three", "A B C D", "costs $5 & more", "né ü 日本　x y 😀 z", "\x00 \x0b\x1c\x1f", "▁▁ a▁b  ▁",
    "word " * 300, " ".join(f"w{i}" for i in range(250)), "word " * 300, LONG, "<s> </s> <0x41>", "=" * 3_000, "x" * 500 + "  " * 40,
]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, [None, "", "en", "de"][i % 4], "x", 1, 2, None, "o", "c", 9) for i, t in enumerate(TEXTS)]
    same = ("same text", "en", None, None, None, None, None, None, None)
    return made + [(5, " a", "en", *same[2:]), (5, "other", "en", *same[2:]), (None, "word " * 300, "fr", *same[2:]), (None, None, None, *same[2:])] + [(1_000 + i // 2, *same) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_audit(rows, labels):
    first, out = {}, Counter()
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    cells = Counter()
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (r[0] is not None and first[text] < r[0])
        cells[r[2] or "", fails, r[0] in good, r[0] in toxic] += 1
    for (part, fails, is_good, is_toxic), n in cells.items():
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = any(x in fails for x in order[: step - 1])
                hit = f in fails
                gone = hit and not before
                out.update({(part, order, step, k): n * v for k, v in dict(
                    kept=not hit and not before, removed=gone, redundant=hit and before, unique_fails=fails == f, good_lost=gone and is_good, toxic_lost=gone and is_toxic).items()})
                out[part, f, "shapley"] += n * gone
    return out


def test_filter_audit(spark, docs, rows):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, None), (5, None, 1), (14, 1, 1), (16, 1, 0), (17, 1, 1), (1_001, 1, 1), (None, 1, 1), (999_999, 1, 1)]
    told = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, told).collect()
    wanted = brute_audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[k] == wanted[r.part, r.filter_order, r.step, k], (r, k)
        assert r.shapley == wanted[r.part, r.filter_order[r.step - 1], "shapley"]
    assert dict(filter_audit.audit(docs, told).dtypes)["step"] == "int"


def test_filter_audit_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit(docs, none).collect())
    assert filter_audit.audit(docs.limit(0), none).count() == 0


def test_filter_audit_counts_a_hot_text_before_it_moves(spark):
    """A third of all rows with one text, dealt over many tasks: the result is exact, one row is the original."""
    hot = spark.range(30_000, numPartitions=16).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copied' ELSE concat('text ', id) END AS text", "'en' AS lang")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: r["n"] for r in filter_audit.mask_cells(hot, none).collect()}
    assert cells == {1: 20_001, 17: 9_999}


def brute_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, rows):
    more = [(10_000 + i, f"{'<' * (i % 3)}ä b\tc <S d{i}  S> <<", *[None] * 8) for i in range(300)]
    made = fill_middle.fill_in_middle(docs.unionByName(spark.createDataFrame(more, SCHEMA)))
    got = made.withColumn("back", fill_middle.restored(made["output"], made["form"])).collect()
    wanted = Counter((r[0], *brute_middle(r[0], r[1])) for r in rows + more)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == wanted
    texts = Counter((r[0], r[1] or "") for r in rows + more)
    assert Counter((r.doc_id, r.back) for r in got) == texts
    assert {"plain", "spm", "psm"} == {r.form for r in got}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_long_texts_among_short_ones(spark):
    """Portions: a text longer than one goes alone, whatever lies around it."""
    texts = [*["a b"] * 5, "lorem ipsum\n" * 700_000, "", "c", *["d  e f"] * 9]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in fill_middle.fill_in_middle(many, percent=100).collect()}
    assert [got[i].n for i in range(len(texts))] == [len(re.findall(r"\s*\S+|\s+", t)) for t in texts]
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.doc_id: bytes(r.ids) for r in pieces.encode_decode(many, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(np.frombuffer(ids[i], "<u4").tolist() == own.encode(t, add_bos=True, add_eos=True) for i, t in enumerate(texts))


def test_rank_and_select():
    draw = np.random.default_rng(3)
    for size, share in ((1, 1.0), (64, 0.5), (512, 0.5), (513, 1.0), (5_000, 0.01), (5_000, 0.9), (1_024, 0.0)):
        plain = draw.random(size) < share
        bits = fill_middle.Bits(plain)
        assert bits.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(plain).tolist()]
        ones = np.flatnonzero(plain)
        assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


@pytest.mark.parametrize("size", [0, 3, 1 << 17])
def test_pieces(docs, rows, size):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded) for r in pieces.encode_decode(docs, path, table_size=size).collect())
    ids = [(r[0], own.encode(r[1] or "", add_bos=True, add_eos=True)) for r in rows]
    assert got == Counter((i, tuple(x), own.decode(x)) for i, x in ids)
    assert len(pieces.shared_chunks(docs, path, size)) <= size
    assert pieces.encode_decode(docs.limit(0), path).count() == 0


def test_segments_and_decodes_like_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, table = sentencepiece.SentencePieceProcessor(model_file=path), pieces.ChunkTable(pieces.PieceModel(path))
    draw, letters = random.Random(5), " ▁▁  \t\n\r\x00aabcdeithn0123éß日本😀\U0001f9ff<>/s.ﬁA　\xa0"
    for k in range(4_000):
        n = draw.choice([0, 1, 2, 3, 5, 10, 40, 150, 400])
        text = "".join(draw.choices(letters, k=n)) if k % 3 else draw.choice(["a", "ab", "▁", " ", "the", "=", "0"]) * n
        ids = np.frombuffer(table.encode_many([text])[0], "<u4").tolist()
        assert table.model.segment_many([text[:60]]) == [np.array(table.model.segment(text[:60]), "<u4").tobytes()]
        assert ids == own.encode(text, add_bos=True, add_eos=True)
        assert table.model.decode(ids) == own.decode(ids)
        table.shrink()
        some = [draw.choice([0, 1, 2, draw.randrange(3, 259), draw.randrange(259, 32_000), 28_705, 259]) for _ in range(draw.randrange(9))]
        assert table.model.decode(some) == own.decode(some)


def test_each_distinct_chunk_is_segmented_once():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, seen = pieces.PieceModel(path), []
    plain = model.segment_many
    model.segment_many = lambda chunks: seen.extend(chunks) or plain(chunks)
    table = pieces.ChunkTable(model, {"▁known": b"\0\0\0\0"})
    for _ in range(3):
        table.encode_many(["some words known some  words again " * 50] * 2)
    assert sorted(seen) == sorted({c for c in pieces.chunks_of("some words known some  words again " * 50)} - {"▁known"})


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_fill_middle"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(wanted.fetchall())


def test_piece_query(spark):
    folder = "/root/testdata/sf0.001"
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall())
    rows = queries.queries()["op13_pieces"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()

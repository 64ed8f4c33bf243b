"""Byte-level BPE against the tokenizer library, and round trips."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from titerframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts() -> list[str | None]:
    rng = random.Random(11)
    # several scripts, blanks of all kinds, contractions, marks, and letters that only recent versions of Unicode know
    pools = ["abcdefgh 's't", "aé ñüß  ", "абв 中文字 ١٢", " \t\n\r\x0b\x0c  　", "=-+!?'#  \n", "0123 .,", "\U0001f600́‍ \U00031350\U00010d4a\U00010d40 a", "'llvere'd're don't  'x", "\x00\x1c\x85 z "]
    out = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    out += ["".join(rng.choice(p) for _ in range(rng.randrange(1, 40))) for p in pools for _ in range(40)]
    out += [None, "", " ", "  \n", "a" * 2500, "=" * 3001, "ab" * 700, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1500)), "中文" * 300, "<|endoftext|> x", "é" * 49, "x" * 48, "x" * 49]
    return out


def test_encodes_as_the_library_and_decodes_back(spark, library):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "decoded", "w")})
    rows = {r.doc_id: r for r in bpe.encode(df).collect()}
    assert len(rows) == len(given)
    for i, text in enumerate(given):
        assert rows[i].ids == library.encode_ordinary(text or ""), repr(text)[:80]
        assert bytes(rows[i].decoded) == (text or "").encode()


def test_decoding_by_itself(spark, library):
    lists = [library.encode_ordinary(t or "") for t in texts()] + [None, [], [5, None], [10**6], [0] * 500_000]
    want = [library.decode_bytes(x) if x is not None and None not in x and max(x, default=0) < 10**6 else None for x in lists]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df).collect()}
    assert [None if got[i] is None else bytes(got[i]) for i in range(len(lists))] == want
    assert bpe.decode(df.limit(0)).count() == 0


def test_a_worker_that_forgets_words_returns_the_same(monkeypatch, library):
    import pyarrow as pa

    known = bpe._Words(PATH)
    rng = random.Random(5)
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "SHORT_BYTES", 40)
    monkeypatch.setattr(bpe, "LONG_BYTES", 100)
    for _ in range(5):
        lists = [["".join(rng.choice("abcxyzé") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(0, 20))] for _ in range(6)]
        words = pa.array([["not read"], *lists], pa.list_(pa.string())).slice(1)
        ids, decoded = known.encode(words)
        assert ids.to_pylist() == [[i for w in ws for i in library._encode_single_piece(w.encode())] for ws in lists]
        assert decoded.to_pylist() == ["".join(ws).encode() for ws in lists]


def test_the_merge_table_marks_pairs_that_must_wait():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"xa": 400, b"xab": 290, b"cd": 301}
    rows = {(r["a"], r["b"]): (r["id"], r["safe"]) for r in bpe.merge_table(ranks).to_pylist()}
    assert rows[97, 98] == (300, False) and rows[99, 100] == (301, True) and rows[120, 300] == (290, True) and rows[400, 98] == (290, True)


def test_odd_documents(spark, odd_docs, library):
    got = sorted((str(r.doc_id), r.ids) for r in bpe.encode(odd_docs).collect())
    assert got == sorted((str(r.doc_id), library.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    assert bpe.encode(odd_docs.limit(0)).count() == 0


def test_the_query_has_a_row_of_digests_for_every_document(spark, library):
    got = sorted(map(tuple, bpe.op11_byte_bpe(spark, SF).collect()))
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)

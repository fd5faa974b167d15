import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import bpe, queries
from fleetlens.llm.bpe import Vocabulary, decode, encode, ids_digest, parts, round_trip, vocabulary

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    return [found.tolist() for _, found in vocabulary(PATH).encode(texts)]


@given(st.lists(st.text(st.sampled_from(list("'stmdrvel  \n\t　aé1½!.-中\U0001f600\x1c\x85'")), max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_boundaries(library, texts):
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point(library):
    texts = [f"ab{c}c1{c}2 {c}{c} .{c}! '{c}s  {c} x" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    wrong = [t for t, i in zip(texts, ids(texts)) if i != library.encode_ordinary(t)]
    assert not wrong, [hex(ord(t[2])) for t in wrong[:50]]


def test_long_texts_and_slices(library):
    rnd = random.Random(1)
    texts = ["a" * 3000, "".join(rnd.choice("abcé") for _ in range(5000)), " " * 4000, "it's " * 60_000, "\n \n" * 700 + "x", ""]
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_tokens_part(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHARS", 40)
    rnd = random.Random(9)
    signs = ["a", "é", "1", " ", "  ", "\n", "\t ", "'s", "'ll", "'", "!", "\u3000", "\x1c", "\x85", "中"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(400))) for _ in range(300)] + ["x" * 900]
    assert all("".join(parts(t)) == t for t in texts)
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_memory_of_slices_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20_000)
    own, rnd = Vocabulary(PATH), random.Random(12)
    word = lambda: "".join(rnd.choice("qzxjkvéaeiou") for _ in range(rnd.randrange(1, 30)))
    for _ in range(30):
        texts = [" ".join(word() for _ in range(20)) + " " + "ab" * 50 for _ in range(3)]
        assert [found.tolist() for _, found in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert own.held <= 20_000 and all(len(piece) <= bpe.SHORT for piece in own.recent)
        assert own.held == sum(bpe.ENTRY_BYTES + len(p) + bpe.ID_BYTES * len(i) for p, i in own.recent.items())


def test_round_trip_with_edge_rows(spark):
    rows = [(1, "it's  a tést\n", 3), (1, "it's  a tést\n", 3), (None, "x", None), (2, None, 1), (3, "", 1), (4, "ab " * 40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = decode(encode(docs, PATH), PATH).collect()
    assert sorted((tuple(r.row) for r in out), key=str) == sorted(rows, key=str)
    for r in out:
        assert bytes(r.decoded) == (r.row.text or "").encode()
        assert len(r.ends) == len(r.ids) and (not r.ends or r.ends[-1] == len(r.decoded))
        half = len(r.ids) // 2
        assert half == 0 or Vocabulary.decode(vocabulary(PATH), r.ids[:half]) == bytes(r.decoded)[: r.ends[half - 1]]
    assert encode(docs.limit(0), PATH).count() == 0
    digests = sorted(map(tuple, round_trip(docs, PATH).collect()), key=str)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    wanted = [(r.row.doc_id, len(r.ids), sha(",".join(map(str, r.ids)).encode()), sha((r.row.text or "").encode())) for r in out]
    assert digests == sorted(wanted, key=str)
    assert ids_digest(np.arange(200_000)) == sha(",".join(map(str, range(200_000))).encode())


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

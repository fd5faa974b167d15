import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import queries
from fleetlens.llm.packing import Encoder, Limits, Packer, Piece, pack

JSON = public_tokenizers.path("byte_bpe_50k.json")


def placed(lengths, limits, loss=None):
    packer, out = Packer(limits, 0), []
    for i, n in enumerate(lengths):
        bears = np.ones(n, int) if loss is None else np.array([(i + k) % loss == 0 for k in range(n)], int)
        out += packer.add(Piece(i, 0, np.arange(n, dtype=np.int32), np.concatenate(([0], np.cumsum(bears))), n))
    return out + list(packer.finish())


def held(found, lengths, limits):
    places, sequences = defaultdict(list), defaultdict(list)
    for piece, sequence, offset in found:
        places[piece.row_id].append((piece.start, len(piece.ids)))
        sequences[sequence].append((offset, *piece.vector()))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(places[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n, _, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p[3] for p in pieces) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding, len(sequences)


@given(st.lists(st.integers(1, 300), max_size=120), st.integers(2, 64), st.integers(1, 64), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_every_token_is_placed_within_the_limits(lengths, segments, loss_tokens, loss):
    limits = Limits(64, segments, loss_tokens)
    held(placed(lengths, limits, loss), lengths, limits)


def test_little_padding():
    rnd = random.Random(3)
    lengths = [rnd.choice([1, 5, 300, 900, 2000, 40_000]) + rnd.randrange(200) for _ in range(6000)]
    padding, sequences = held(placed(lengths, Limits()), lengths, Limits())
    assert padding == 0 and sequences <= sum(lengths) // 1024 + 11


def test_only_tiny_pieces():
    padding, _ = held(placed([1] * 5000, Limits()), [1] * 5000, Limits())
    assert padding == 0


def test_libraries_agree():
    own = Encoder(JSON)
    for text in ["", "a", " a  b\n\n c", "it's we're 123 é中\U0001f600 x", "x" * 5000, "a<|endoftext|>b", "İſ\u0085 \x1c'S"]:
        assert own.ids(text).tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_documents(spark):
    rows = [(1, "some words here " * 900, 5), (1, "some words here " * 900, 5), (2, None, 1), (3, "", 2), (None, "null id", 3), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    out = pack(docs, JSON).collect()
    own = Encoder(JSON)
    tokens = defaultdict(int)
    for r in out:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = own.ids(text)
        assert r.ids == ids[r.start : r.start + r.length].tolist() and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.loss_tokens == r.length
        tokens[r.doc_id] += r.length
    assert tokens == {1: 2 * 2701, 2: 1, 3: 1, None: len(own.ids("null id")), 4: 2} or tokens[1] == 2 * len(own.ids(rows[0][1]))
    assert pack(docs.limit(0), JSON).count() == 0


def test_loss_mask(spark):
    docs = spark.createDataFrame([(1, "question one? answer two", 13), (2, "all", None)], "doc_id bigint, text string, loss_from bigint")
    got = defaultdict(lambda: [0, 0])
    for r in pack(docs, JSON, Limits(64, 4, 64)).collect():
        got[r.doc_id][0] += r.length
        got[r.doc_id][1] += r.loss_tokens
    assert got[2][0] == got[2][1] and 0 < got[1][1] < got[1][0]


@pytest.mark.parametrize("name", ["op3_packed_sequences"])
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own, pieces, sequences = Encoder(JSON), defaultdict(list), defaultdict(list)
    for r in queries.QUERIES[name](spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids, at = own.ids(texts[doc_id]), 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].astype("<u4").tobytes())
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


@pytest.mark.parametrize("none", ["tokens", "segments", "loss_tokens"])
def test_sequences_that_can_hold_nothing_are_refused(none):
    with pytest.raises(ValueError):
        Limits(**{none: 0})

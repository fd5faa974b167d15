import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import queries
from fleetlens.llm.resampling import SlicedGains, bucket_totals, draw, gains, planes, resample

SCHEMA = "doc_id bigint, text string, score string, rank int"


def plain_features(text, runs):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, min_words, runs, buckets, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in plain_features(t, runs)[1])
    t = Counter(place(f) for text in target for f in plain_features(text, runs)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = plain_features(text, runs)
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
        weight = math.floor(sum(gain(place(f)) for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[2]))
    drawn = {id(r): n + 1 for n, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r, drawn.get(id(r))) for r in rows)


def random_docs(n):
    rnd = random.Random(4)
    words = ["the", "The", "über", "x1", "model", "_", "a-b", "中文", "\U0001f600", "\x00", "42"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(n)]
    return docs + [(None, None), (None, "model " * 30), (n, ""), (n + 1, None), (n + 2, "model 42 " * 40_000), docs[5], docs[5]]


@pytest.mark.parametrize("runs, buckets, percent", [(1, 10_000, 10), (2, 70, 50), (3, 1, 100)])
def test_equal_to_the_plain_version(spark, runs, buckets, percent):
    docs, target = random_docs(150), ["model model x1", "Über 42", None, ""]
    frame = spark.createDataFrame([(*d, "clash", 7) for d in docs], SCHEMA)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame, goal, percent, 20, runs, buckets, 11)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(docs, target, percent, 20, runs, buckets, 11)


def test_planes_hold_the_bits_and_sums_are_exact():
    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 1 << 20, (7, 131)).astype(np.int32)
    counts[3] = 0
    bits = planes(counts, 20)
    assert bits.shape == (7, 20, 3)
    for row, bucket, bit in [(0, 0, 0), (2, 64, 19), (6, 130, 7)]:
        assert int(bits[row, bit, bucket // 64]) >> (bucket % 64) & 1 == int(counts[row, bucket]) >> bit & 1
    numbers = rnd.integers(-30_000, 30_000, 131).tolist()
    assert SlicedGains.of(numbers).sums(counts) == [sum(c * g for c, g in zip(row, numbers)) for row in counts.tolist()]
    for edge in ([-1], [0], [7], [-8], [8, -9]):
        assert SlicedGains.of(edge).sums(np.ones((1, len(edge)), np.int32)) == [sum(edge)]


def test_weights_come_from_the_planes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "model model x", "", 0)], SCHEMA)
    numbers = gains(bucket_totals(docs), bucket_totals(docs.limit(0)))
    sliced = SlicedGains.of(numbers)
    sliced.planes[:] = 0
    assert sliced.sums(np.ones((1, 10_000), np.int32)) == [0]
    assert SlicedGains.of(numbers).sums(np.ones((1, 10_000), np.int32)) == [sum(numbers)]


def test_ranks_across_one_hot_score(spark):
    rows = [(i, 30, 30, 0, 5) for i in range(60)] + [(100 + i, 30, 30, 0, 9) for i in range(3)] + [(200, 19, 19, 0, 99)]
    frame = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = {r.doc_id: r["rank"] for r in draw(frame, 10, 20).collect()}
    assert {k: v for k, v in got.items() if v} == {100: 1, 101: 2, 102: 3, 0: 4, 1: 5, 2: 6}
    assert len(got) == 64


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert resample(nothing, nothing.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a b " * 20, "", 0)], SCHEMA)
    assert [r["rank"] for r in resample(one, nothing.select("text"), percent=100).collect()] == [1]
    with pytest.raises(ValueError):
        resample(one, nothing.select("text"), percent=101)


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_resampled"](spark, sf).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == Counter(
        {(k[0], *k[2:]): v for k, v in brute(docs, target, 10, 20, 1, 10_000, 2024).items()}
    )

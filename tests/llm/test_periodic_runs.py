import hashlib
import random
import time
import zlib

import pytest

from fleetlens.llm import periodic_runs, queries
from fleetlens.llm.periodic_runs import find_runs, longest, runs_of_documents, with_planted_tails

SCHEMA = "doc_id bigint, text string, runs int, n_words string"


def brute(words, least=12, periods=2):
    """Every stretch on every lag, the smallest lag of equal stretches."""
    found = {}
    for lag in range(1, len(words)):
        i = 0
        while i + lag < len(words):
            start = i
            while i + lag < len(words) and words[i] == words[i + lag]:
                i += 1
            if i - start + lag >= max(least, periods * lag) and i > start:
                found.setdefault((start, i - start + lag), lag)
            i = max(i, start + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words and doc_id is not None:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    exponent = 1000 * top[1] // top[2] if runs else None
    return (doc_id, len(runs), *top, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_words(rnd, most):
    n, kinds = rnd.randrange(most), rnd.choice([1, 2, 3, 40])
    words = [f"w{rnd.randrange(kinds)}".encode() for _ in range(n)]
    for _ in range(rnd.randrange(4) if n else 0):
        a = rnd.randrange(n)
        p, e = rnd.randrange(1, n - a + 1), rnd.randrange(a, n + 1)
        words[a:e] = [words[a + (i - a) % p] for i in range(a, e)]
    return words


@pytest.mark.parametrize("least, periods", [(12, 2), (2, 2), (5, 3), (20, 2)])
def test_equal_to_the_plain_version(least, periods):
    rnd = random.Random(least)
    for _ in range(300):
        group = [periodic_words(rnd, 90) for _ in range(rnd.randrange(1, 6))]
        got = [[tuple(r) for r in runs.tolist()] for runs in runs_of_documents(group, least, periods)]
        assert got == [brute(words, least, periods) for words in group]


def test_long_periods_whose_phrases_all_recur_nearer():
    rnd = random.Random(3)
    part = [rnd.choice([b"x", b"y"]) for _ in range(1500)]
    words = [b"start", *part, *part, b"end"]
    assert (1, 3000, 1500) in [tuple(r) for r in runs_of_documents([words])[0].tolist()]


def test_hashes_only_choose_seeds(monkeypatch):
    rnd = random.Random(5)
    group = [periodic_words(rnd, 60) for _ in range(40)]
    wanted = [brute(words) for words in group]
    whole = periodic_runs.phrase_hashes
    # hashes that clash all the time give more seeds and the same runs; without any seed nothing is found
    monkeypatch.setattr(periodic_runs, "phrase_hashes", lambda words, k: whole(words, k) & periodic_runs.np.uint64(3))
    monkeypatch.setattr(periodic_runs, "_mix", lambda values: values & periodic_runs.np.uint64(0))
    assert [[tuple(r) for r in runs.tolist()] for runs in runs_of_documents(group)] == wanted
    monkeypatch.undo()
    monkeypatch.setattr(periodic_runs, "phrase_hashes", lambda words, k: periodic_runs.np.arange(len(words) - k + 1, dtype="uint64") << 32)
    assert sum(map(len, runs_of_documents(group))) == 0


def test_each_stretch_is_extended_once(monkeypatch):
    calls = []
    whole = periodic_runs._stretch
    monkeypatch.setattr(periodic_runs, "_stretch", lambda *a: calls.append(a[2]) or whole(*a))
    assert [tuple(r) for r in runs_of_documents([[b"a"] * 5000])[0].tolist()] == [(0, 5000, 1)]
    assert calls == [1]
    calls.clear()
    assert [tuple(r) for r in runs_of_documents([[b"a", b"b", b"c"] * 900])[0].tolist()] == [(0, 2700, 3)]
    assert calls == [3]


def test_time_grows_with_n_log_n():
    start = time.perf_counter()
    runs_of_documents([[b"a"] * 400_000])
    assert time.perf_counter() - start < 20


def test_rows_of_a_table(spark):
    line = "one two three four five six seven "
    texts = [None, "", " \t\n ", line * 2, line * 2 + "one", "é " * 12, "x\x0by\x0cz\rx y z " * 3, "a " * 70_000 + "b", line, line]
    rows = [(None if i == 4 else i % 9, t, 1, "clash") for i, t in enumerate(texts)]
    out = find_runs(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "n_words", "runs", "runs_sha256", "collapsed_text", "collapsed_sha256"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, [tuple(s) for s in r.runs], r.collapsed_text) for r in out.collect())
    wanted = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        runs = [(0, 70_000, 1)] if len(words) > 1000 else brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        wanted.append((doc_id is not None, doc_id or 0, len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == sorted(wanted)
    assert find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame(rows, SCHEMA), periods=1)


def test_longest_breaks_ties(spark):
    rows = [([(9, 20, 4), (3, 20, 7), (3, 20, 5), (1, 19, 2)],), ([],)]
    frame = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = [r[0] for r in frame.select(longest(frame["runs"])).collect()]
    assert tuple(got[0]) == (3, 20, 5) and got[1] is None or got[1].start is None


def test_planted_tails_leave_other_rows_alone(spark):
    rows = [(i, f" a\tb{i} c d " if i % 3 else None) for i in range(60)] + [(None, "a b")]
    got = {r.doc_id: r.text for r in with_planted_tails(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, text in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 or text is None:
            assert got[doc_id] == text


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    wanted = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs if len(r.text or "") < 12_000}
    got = {r[0]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert {k: got[k] for k in wanted} == wanted
    assert sum(v[1] > 0 for v in wanted.values()) > 5

import hashlib
import random
import re
import string
import time

from fleetlens.llm import queries
from fleetlens.llm.secret_scan import CODES, THRESHOLD, find_secrets, spans, train, without_secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base(text):
    found = []
    for k, (kind, rule, group, least) in enumerate(RULES):
        found += [(m.start(), k, m.end(), kind) for m in rule.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def texts():
    rnd = random.Random(2)
    parts = ["token", "Api_KEY", "secret", "=", ":", '"', "'", " ", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "fedcba98", "é", "\U0001f600", "\n", "x", "abc.d", "pass", "passwd"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(400)]
    return out + [None, "", "secret=token: abcdefgh", "a" * 50_000, "password:" + "b" * 50_000, "token=abcdef " * 300]


def plain_words(rnd, n):
    return " ".join(rnd.choice(["the", "these", "motion", "thereof", "stations", "oration", "internationalisation"]) for _ in range(n))


def test_base_findings(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    found = find_secrets(spark.createDataFrame(rows, SCHEMA), [-9.0] * CODES**2)
    got = {r[0]: r[1] for r in found.select("row.doc_id", spans(found["findings"])).collect()}
    assert got == {i: base(t) for i, t, *_ in rows}


def test_models_tell_random_strings_from_words(spark):
    rnd = random.Random(8)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
    rows = [(i, plain_words(rnd, 60) + (f" token = {key(40)} " if i % 5 == 0 else " "), "en", "s", 1) for i in range(200)]
    hidden = [(1000 + i, plain_words(rnd, 30) + " " + key(32) + " the", "en", "s", 1) for i in range(20)]
    long_words = [(2000 + i, "thereofstationsmotionoration" + plain_words(rnd, 5), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows + hidden + long_words, SCHEMA)
    found = find_secrets(docs)
    got = {r[0]: r[1] for r in found.select("row.doc_id", spans(found["findings"])).collect()}
    assert all(re.fullmatch(r"random:\d+:\d+", got[i]) for i, *_ in hidden)
    assert all(got[i] == "" for i, *_ in long_words)
    assert all(got[i] == base(t) for i, t, *_ in rows)


def test_redaction_keeps_columns(spark):
    rows = [
        (1, "é token = abcdefgh, x", 5, 20), (1, "é token = abcdefgh, x", 5, 20), (None, None, None, None),
        (3, "", 0, 0), (4, "plain", 1, 77), (5, "token=" + "0a" * 20 + " é AKIA" + "Q" * 20, 1, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, findings int, n_chars bigint")
    out = without_secrets(docs)
    assert out.columns == docs.columns
    wanted = [(1, "é [SECRET], x", 5, 13)] * 2 + [(None,) * 4, (3, "", 0, 0), (4, "plain", 1, 77), (5, "[SECRET] é [SECRET]", 1, 19)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(wanted, key=str)


def plain_random(text, odds):
    """Candidates that no base finding overlaps and whose pairs are likelier in random strings."""
    taken = [(m.start(), m.end()) for k, (_, rule, group, least) in enumerate(RULES) for m in rule.finditer(text or "") if len(m.group(group)) >= least]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        score = sum(odds[ord(a) * CODES + ord(b)] for a, b in zip(m.group(), m.group()[1:]))
        if all(m.end() <= a or b <= m.start() for a, b in taken) and score > THRESHOLD * (len(m.group()) - 1):
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def test_random_strings_by_a_plain_log_likelihood(spark):
    rnd = random.Random(17)
    odds = [round(rnd.uniform(-1, 2), 3) for _ in range(CODES**2)]
    word = lambda: "".join(rnd.choice("abcXYZ019+/_=-") for _ in range(rnd.choice([5, 19, 20, 21, 40])))
    made = [" ".join(rnd.choice([word(), "token=abcdefgh" + word(), "é", "AKIA" + "Q" * 20, "0a" * 14]) for _ in range(rnd.randrange(30))) for _ in range(150)]
    made.append(" ".join(word() + rnd.choice(["", " token=abcdefgh"]) for _ in range(900)))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts() + made)]
    found = find_secrets(spark.createDataFrame(rows, SCHEMA), odds)
    got = {r[0]: r[1] for r in found.select("row.doc_id", spans(found["findings"])).collect()}
    for i, text, *_ in rows:
        assert sorted(filter(None, got[i].split(","))) == sorted(filter(None, [*base(text).split(","), *plain_random(text, odds)])), text
    assert sum("random" in v for v in got.values()) > 50


def test_time_for_a_long_text_grows_with_its_length(spark):
    rnd = random.Random(1)
    dump = " ".join("%032x" % rnd.getrandbits(128) for _ in range(62_000))
    blob = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(300_000))
    rows = [(1, "é " + dump, "en", "s", 1), (2, blob, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    docs.count()
    start = time.perf_counter()
    found = find_secrets(docs, [1.0] * CODES**2)
    got = {r[0]: r[1] for r in found.select("row.doc_id", spans(found["findings"])).collect()}
    assert time.perf_counter() - start < 20
    assert got[1] == base(rows[0][1]) and got[2] == "random:0:300000"
    start = time.perf_counter()
    clean = {r.doc_id: r.text for r in without_secrets(docs).collect()}
    assert time.perf_counter() - start < 40
    assert clean[1] == "é " + " ".join(["[SECRET]"] * 62_000)


def test_redaction_equals_plain_cutting(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())] + [(9000, "é" * 5000 + " token=abcdefgh " + "x é" * 4000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odds = train(docs)
    found = find_secrets(docs, odds)
    spans_of = {r[0]: sorted((m.start, m.end) for m in r[1]) for r in found.select("row.doc_id", "findings").collect()}
    for doc_id, text in without_secrets(docs).select("doc_id", "text").collect():
        whole, out, at = rows[doc_id if doc_id < 9000 else -1][1], "", 0
        for start, end in spans_of[doc_id]:
            if start >= at:
                out += whole[at:start] + "[SECRET]"
            at = max(at, end)
        assert text == (out + whole[at:] if spans_of[doc_id] else whole)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert find_secrets(docs).count() == 0
    assert set(train(docs)) == {0.0}


def test_query(spark):
    rows = queries.QUERIES["op10_secret_spans"](spark, "/root/testdata/sf0.001").collect()
    texts_ = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts_)
    for r in rows:
        wanted = base(texts_[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [wanted.count(k + ":") for k in ("assign", "access", "hex")]
        assert set(wanted.split(",")) - {""} <= set(r.spans.split(","))

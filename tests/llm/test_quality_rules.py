import random
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import queries
from fleetlens.llm.quality_rules import FEATURES, _measure, judge, keep_good, learn, verdict

SF_DIR = "/root/testdata/sf0.01"
WORD = "[^ \t-\r]+"


def base(text):
    import re

    words = re.findall(WORD, text or "", re.A)
    triples = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x, re.A)]
    # equal lines are compared by their bytes
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("seed", range(30))
def test_statistics(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["a", "b", "a b a", " ", "\n", "\t", "é", "\x85", "\xa0", "#", "<a>", "\r\n", "x\n"]) for _ in range(rnd.randrange(120)))
    assert _measure(text)[:5] == base(text)


@pytest.mark.parametrize("text", [None, "", " \n \n", "one", "a a a a", "b\n" * 30_000])
def test_statistics_of_odd_texts(text):
    assert _measure(text)[:5] == base(text)


def test_rules_are_learnt_and_precise():
    rnd = np.random.default_rng(4)
    n = 3000
    table = {name: rnd.random(n) for name in FEATURES}
    bad = (table["symbol_ratio"] > 0.9) | ((table["upper_ratio"] > 0.8) & (table["digit_ratio"] < 0.3))
    rules = learn(table, bad, rnd.integers(0, 3, n))
    caught = np.zeros(n, bool)
    for rule in rules:
        held = np.ones(n, bool)
        for condition in rule:
            held &= condition.holds(table)
        caught |= held
    assert (caught & bad).sum() > 0.9 * bad.sum()
    assert (caught & ~bad).sum() < 0.02 * n


def test_labels_without_a_pattern_give_no_rules():
    rnd = np.random.default_rng(4)
    table = {name: rnd.random(2000) for name in FEATURES}
    assert learn(table, rnd.random(2000) < 0.1, rnd.integers(0, 3, 2000)) == []


def test_query_and_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op8_quality_rules"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, wanted = rows[d.doc_id], base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
        assert not (r.base_failed and r.kept)
    labels = [(x.quality, rows[x.doc_id]) for x in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()]
    good = [r.kept for q, r in labels if q == 1 and not r.base_failed]
    bad = [r.kept for q, r in labels if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", True), (1, text, "a", True), (None, text, None, None), (2, None, "b", False), (3, "", "c", None)], "doc_id bigint, text string, n_words string, kept boolean")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    judged = judge(docs, labels)
    assert sorted((r.row.doc_id or 0, r.base_failed, r.kept) for r in judged.collect()) == [(0, False, True), (1, False, True), (1, False, True), (2, True, False), (3, True, False)]
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3
    none = spark.createDataFrame([], docs.schema)
    assert judge(none, labels).count() == 0 and judge(docs, labels.limit(0)).count() == 5
    assert spark.range(1).select(verdict([])).first()[0] is True

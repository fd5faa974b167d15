import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import language_id, queries
from fleetlens.llm.language_id import PAD, UNIT, Scorer, _digest, _strings, identify, train

WORDS = {"aa": ["the", "of", "shore", "ness"], "bb": ["la", "été", "que", "mér"], "cc": ["über", "und", "schön", "keit"]}


def sample(rnd, lang, n=60):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "n"]) for _ in range(n))


def plain_bits(train_texts, text):
    """Code length by walking contexts one by one."""
    followed = [Counter() for _ in range(4)]
    for t in train_texts:
        data = PAD + t.encode()
        for i in range(3, len(data)):
            for depth in range(4):
                followed[depth][data[i - depth : i], data[i]] += 1
    bits, data = 0.0, PAD + text.encode()
    for i in range(3, len(data)):
        for depth in range(3, -1, -1):
            context = data[i - depth : i]
            here = {s: n for (c, s), n in followed[depth].items() if c == context}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if data[i] in here:
                bits -= math.log2(here[data[i]] / whole)
                break
            bits -= math.log2(len(here) / whole)
        else:
            bits += 8
    return bits


def counts(texts):
    return np.unique(np.concatenate([_strings(PAD + t.encode()) for t in texts]), return_counts=True)


def test_code_lengths_are_exact():
    rnd = random.Random(4)
    texts = {lang: [sample(rnd, lang, 15) for _ in range(4)] for lang in WORDS}
    scorer = Scorer({lang: counts(own) for lang, own in texts.items()})
    for text in ["", "a", "ß?\x00", sample(rnd, "bb", 9), "\U0001f600 the été", sample(rnd, "aa", 5) + "#@!"]:
        for _ in range(2):
            assert scorer.units(text.encode()) / UNIT == pytest.approx([plain_bits(texts[lang], text) for lang in scorer.languages], rel=1e-5)


def test_lengths_do_not_hang_on_what_the_table_holds(monkeypatch):
    rnd = random.Random(6)
    model = {lang: counts([sample(rnd, lang, 30)]) for lang in WORDS}
    texts = [sample(rnd, rnd.choice(list(WORDS)), 3000) + "".join(chr(rnd.randrange(1, 0xD000)) for _ in range(3000)) for _ in range(3)]
    texts += ["\0" * 50, "a", *texts]
    large = Scorer(model)
    wanted = [large.units(t.encode()).tolist() for t in texts]
    # eight places, and parts that cut texts
    monkeypatch.setattr(language_id, "TABLE_BYTES", 8 * (4 + 4 * len(model)))
    small = Scorer(model)
    small.chunk = 500
    assert len(small.keys) == 8
    assert [small.units(t.encode()).tolist() for t in texts] == wanted


def test_many_scripts_take_bounded_memory():
    rnd = random.Random(2)
    starts = [0x400 + 0x500 * i for i in range(40)]
    write = lambda start, n: "".join(chr(start + rnd.randrange(0x300)) for _ in range(n))
    tracemalloc.start()
    scorer = Scorer({f"s{i:02}": counts([write(start, 5000)]) for i, start in enumerate(starts)})
    for i, start in enumerate(starts):
        assert scorer.predict(write(start, 50_000))[0] == f"s{i:02}"
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_equal_lengths_go_to_the_first_name():
    same = counts(["one text for both"])
    assert Scorer({"zz": same, "mm": same}).predict("one text") == ("mm", 0.5)
    assert _digest({"a": same}) == _digest({"a": same}) != _digest({"b": same})


def test_long_texts_are_trained_on_only_where_others_lack(spark):
    rows = [(f"{i} ab", "aa") for i in range(5)] + [("x" * 300, "aa"), ("y" * 300, "bb"), ("y z", "bb")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = train(docs, sample_docs=5, text_bytes=100)
    assert model["aa"][1].sum() == sum(len(t) for t, _ in rows[:5])
    assert model["bb"][1].sum() == 303
    for name, own in (("aa", [t for t, _ in rows[:5]]), ("bb", ["y" * 300, "y z"])):
        assert all(np.array_equal(a, b) for a, b in zip(model[name], counts(own)))


def test_edge_rows(spark):
    rnd = random.Random(1)
    rows = [(i, sample(rnd, lang), lang, "x") for i in range(60) for lang in WORDS]
    rows += [(1, None, "aa", "x"), (2, "", "aa", "x"), (3, "12 .", "bb", "x"), (None, sample(rnd, "cc"), None, "x"), (5, sample(rnd, "bb", 40_000), "bb", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = train(docs, 20)
    assert sorted(model) == sorted(WORDS)
    got = identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if not r.row.text or r.row.text == "12 .":
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (r.row.lang or "cc") and 0 <= r.score <= 1
    none = docs.limit(0)
    assert train(none) == {} and identify(none, model).count() == 0
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_language_by_ppm"](spark, sf_dir).collect()
    assert len(rows) == len(langs)
    judged = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(judged) > 150 and sum(judged) >= 0.97 * len(judged)

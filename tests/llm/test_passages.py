import random

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import passages
from fleetlens.llm.passages import Shard, remove_repeats, without_repeats

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def check(spark, rows, window):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = remove_repeats(docs, window).collect()
    wanted = brute.removed([r[1] for r in rows], window)
    assert sorted((tuple(r.row), r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got if r.row.doc_id is not None) == sorted(
        (tuple(r), *w) for r, w in zip(rows, wanted) if r[0] is not None
    )
    assert len(got) == len(rows)


@pytest.mark.parametrize("window", [2, 3, 5, 8, 35])
def test_against_brute_force(spark, window):
    rnd = random.Random(window)
    word = lambda: rnd.choice(["é", "b", "c", "d e"] if window < 6 else [f"w{i}" for i in range(200)])
    shared = [[word() for _ in range(rnd.randrange(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [word() for _ in range(rnd.randrange(2 * window))] + (rnd.choice(shared)[rnd.randrange(3) :] if rnd.random() < 0.5 else [])
        rows.append((i, "\n".join(words) if i % 3 else " ".join(words) + "  ", "en", "s", 0))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), rows[5], rows[5], (202, rows[7][1], "de", "t", 1)]
    check(spark, rows, window)


def test_hot_passage_and_self_repeat(spark):
    rnd = random.Random(1)
    hot = " ".join(f"h{i}" for i in range(40))
    rows = [(i, " ".join(f"u{rnd.random()}" for _ in range(50)) + " " + hot + f" tail{i}", "en", "s", 1) for i in range(300)]
    own = " ".join(f"o{i}" for i in range(50))
    rows += [(900, own + " x " + own, "en", "s", 1), (901, "same " * 36, "en", "s", 1), (902, "other " * 35, "en", "s", 1)]
    check(spark, rows, 35)


def test_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text + "  a", 7, 8, "k"), (2, text, 7, 8, "k"), (3, "kept  as\nis", 7, 8, "k"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int, n_chars bigint, row string")
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a", 7, 1, "k"), (2, "", 7, 0, "k"), (3, "kept  as\nis", 7, 8, "k"), (None, None, None, None, None)], key=str
    )


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def cut(texts, sent, window=35):
    """What the last step makes of texts, given the passages sent to each: ``(owner, first word, words)``."""
    row = pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts)], pa.struct([("doc_id", pa.int64()), ("text", pa.string())]))
    passage = pa.struct([("owner", pa.int64()), ("first", pa.int32()), ("words", pa.string())])
    found = pa.array([s and [dict(zip(("owner", "first", "words"), p)) for p in s] for s in sent], pa.list_(passage))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), row, found], ["key", "row", "passages"])
    return [n for out in passages._removal(window)(iter([batch])) for n in out.column(2).to_pylist()]


def test_words_go_only_where_the_automaton_hits(monkeypatch):
    shared = " ".join(f"w{i}" for i in range(60))
    texts = [f"a b {shared} c", f"{shared} d"]
    sent = [[(1, 0, texts[1])], [(0, 0, texts[0])]]
    assert cut(texts, sent) == [60, 60]
    assert cut(texts, [None, None]) == [0, 0]
    whole = Shard.compile

    def emptied(self):
        whole(self)
        self.automaton.clear()

    monkeypatch.setattr(Shard, "compile", emptied)
    assert cut(texts, sent) == [0, 0]


def test_passages_that_only_seem_equal_remove_nothing():
    """As if hashes had led a text to a partner that has other words."""
    text = " ".join(f"w{i}" for i in range(40))
    near = " ".join("other" if i == 17 else f"w{i}" for i in range(40))
    assert [cut([text], [[sent]]) for sent in [(7, 0, near), (0, 0, text), (0, 5, text)]] == [[0], [0], [40]]
    # the partner's window is only reached through an anchor in its middle
    assert cut([" ".join(f"w{i}" for i in range(3, 38))], [[(7, 0, text)]]) == [35]


def test_alternating_words_do_not_collide():
    """Sums of powers cancel out over such sequences, whatever the multiplier."""
    bits = np.array([bin(i).count("1") & 1 for i in range(1 << 13)])
    hashes = passages.WordHashes().of([b"a" if b else b"b" for b in bits])
    found = passages._joined(hashes, 1 << 12)
    assert found[0] != found[1 << 12]


def test_partner_of_a_long_text(spark):
    rnd = random.Random(4)
    words = [f"l{rnd.random()}" for _ in range(3000)]
    rows = [(0, " ".join(words), "en", "s", 1)]
    rows += [(i, f"x{i} " + " ".join(words[i * 61 : i * 61 + 33 + i % 5]) + f" y{i}", "en", "s", 1) for i in range(1, 40)]
    rows += [(50, " ".join(words[100:900] + ["z"] + words[500:1300]), "en", "s", 1)]
    check(spark, rows, 35)

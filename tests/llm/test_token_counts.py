import random
import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import queries
from fleetlens.llm.token_counts import CHANGES, TokenRollup, counted, counted_by_file, utf8_bytes, words


def apply(held, rows):
    """Plain version of a batch: the largest change to each document and tokenizer holds, in any batch."""
    key = lambda change: [(x is not None, x) for x in change]
    for op, seq, doc_id, source, lang, tokenizer, tokens in rows:
        if doc_id is None or tokenizer is None or op not in ("insert", "revise", "delete") or (op != "delete" and tokens is None):
            continue
        new, name = (seq, op, tokens, source, lang), (doc_id, tokenizer)
        if name not in held or key(new) > key(held[name]):
            held[name] = new


def totals(state):
    docs, tokens = Counter(), Counter()
    for (_, tokenizer), (_, op, n, source, lang) in state.items():
        if op == "delete":
            continue
        docs[source, lang, tokenizer] += 1
        tokens[source, lang, tokenizer] += n
    return {(*group, docs[group], tokens[group]) for group in docs}


def test_random_batches_and_replays(spark, tmp_path):
    rnd = random.Random(11)
    rollup, state = TokenRollup(spark, str(tmp_path)), {}
    assert rollup.totals().count() == 0
    for batch in range(4):
        rows = [
            (rnd.choice(["insert", "revise", "delete", "insert"]), rnd.choice([0, 1, None]), rnd.choice([None, *range(12)]), rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice(["t1", "t2"]), rnd.choice([0, 5, 9, None]))
            for _ in range(40)
        ]
        rows += rows[:3]
        changes = spark.createDataFrame(rows, CHANGES).withColumn("documents", F.lit("x"))
        assert rollup.commit(f"day {batch}/ü", changes)
        apply(state, rows)
        assert {tuple(r) for r in rollup.totals().collect()} == totals(state)
        assert not rollup.commit(f"day {batch}/ü", changes)
        assert {tuple(r) for r in rollup.totals().collect()} == totals(state)
    assert rollup.commit("none", spark.createDataFrame([], CHANGES))
    assert {tuple(r) for r in rollup.totals().collect()} == totals(state)


def test_late_and_shuffled_batches_give_the_same_totals(spark, tmp_path):
    rnd = random.Random(12)
    rows = [("insert", 0, i, "s", "en", "t", i) for i in range(20)] + [("revise", 2, i, "s", "de", "t", 100 + i) for i in range(0, 20, 2)]
    rows += [("delete", 3, i, None, None, "t", None) for i in range(0, 20, 5)] + [("revise", 1, i, "s", "en", "t", 50) for i in range(20)]
    state = {}
    apply(state, rows)
    for attempt in range(2):
        rnd.shuffle(rows)
        rollup = TokenRollup(spark, str(tmp_path / str(attempt)), buckets=3)
        for n in range(0, len(rows), 15):
            assert rollup.commit(str(n), spark.createDataFrame(rows[n : n + 15], CHANGES))
        assert {tuple(r) for r in rollup.totals().collect()} == totals(state)
        now = {(r.doc_id, r.tokenizer): (r.source, r.lang, r.tokens) for r in rollup.current().collect()}
        assert now == {name: (c[3], c[4], c[2]) for name, c in state.items() if c[1] != "delete"}
    # older than what the ledger holds: a revision, and an insert of what was deleted
    assert rollup.commit("late", spark.createDataFrame([("revise", 0, 2, "s", "en", "t", 1), ("insert", 2, 0, "s", "en", "t", 1)], CHANGES))
    assert {tuple(r) for r in rollup.totals().collect()} == totals(state)


def test_a_batch_reads_only_the_parts_of_its_documents(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path), buckets=8)
    rollup.commit("all", spark.createDataFrame([("insert", 0, i, "s", "en", "t", 1) for i in range(200)], CHANGES))
    touched = {p.name for p in Path(tmp_path, "ledger", "batch=all").glob("bucket=*")}
    rollup.commit("one", spark.createDataFrame([("revise", 1, 7, "s", "en", "t", 5)], CHANGES))
    (one,) = Path(tmp_path, "ledger", "batch=one").glob("bucket=*")
    assert len(touched) == 8 and one.name in touched
    for other in touched - {one.name}:
        for part in Path(tmp_path, "ledger", "batch=all", other).glob("*.parquet"):
            part.write_bytes(b"unreadable")
    assert rollup.commit("two", spark.createDataFrame([("delete", 2, 7, None, None, "t", None)], CHANGES))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 199, 199)]


def test_query_counts_by_public_tokenizers(spark):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    seen, wanted = set(), Counter()
    for r in docs:
        text = r.text or ""
        if text in seen:
            continue
        seen.add(text)
        plain = re.sub(r"(?<![^\x20\x09-\x0D])\|(?![^\x20\x09-\x0D])", "", text)
        for name, n in (("byte_bpe_50k", len(byte.encode(plain, add_special_tokens=False).ids)), ("byte_bpe_multi_50k", len(multi.encode_ordinary(text)))):
            wanted[r.source, r.lang, name, "documents"] += 1
            wanted[r.source, r.lang, name, "tokens"] += n
    got = queries.QUERIES["op5_token_totals"](spark, sf_dir).collect()
    assert len(got) == len(wanted) // 2
    for r in got:
        assert (r.documents, r.tokens) == tuple(wanted[r.source, r.lang, r.tokenizer, kind] for kind in ("documents", "tokens"))


def test_a_batch_that_broke_off_is_not_seen_and_comes_again(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    changes = spark.createDataFrame([("insert", 0, 1, "s", "en", "t", 7)], CHANGES)
    rollup.commit("one", changes)
    for mark in Path(tmp_path, "sums").glob("*/_SUCCESS"):
        mark.unlink()
    assert rollup.totals().count() == 0 and not rollup.committed("one")
    assert rollup.commit("one", changes)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 1, 7)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_counts(spark, name):
    docs = spark.createDataFrame([(1, "a b\x85c\n", "s", "en", 1), (None, None, None, None, 1), (2, "", "s", "en", 1), (3, "é " * 50_000, "s", "en", 1)], "doc_id int, text string, source string, lang string, tokens int")
    got = {(r.doc_id, r.tokenizer): r.tokens for r in counted(docs, {"w": words(F.col("text")), "b": utf8_bytes(F.col("text"))}).collect()}
    assert got == {(1, "w"): 2, (1, "b"): 7, (None, "w"): 0, (None, "b"): 0, (2, "w"): 0, (2, "b"): 0, (3, "w"): 50_000, (3, "b"): 150_000}
    by_file = {r.doc_id: r.tokens for r in counted_by_file(docs, "bpe", public_tokenizers.path(name)).collect()}
    assert by_file[None] == by_file[2] == 0 and by_file[1] > 2
    ranked = {r.doc_id: r.tokens for r in counted_by_file(docs, "bpe", public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert ranked == by_file

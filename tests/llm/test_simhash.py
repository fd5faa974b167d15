import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm.components import connected_components
from fleetlens.llm import queries, simhash
from fleetlens.llm.simhash import BKTree, code_links, fingerprint, fingerprints, keep_one, near_duplicates

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_tree_finds_what_a_scan_finds(codes, query, radius):
    tree = BKTree()
    for code in codes:
        tree.add(code)
    found = sorted(tree.codes[i] for i in tree.within(query, radius))
    assert found == sorted({c for c in codes if (c ^ query).bit_count() <= radius})
    again = BKTree.rebuilt(tree.codes, tree.parents, tree.edges)
    assert sorted(again.codes[i] for i in again.within(query, radius)) == found


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two WORDS", "Ä b c d", "a a a a a", "x " * 40_000])
def test_fingerprint(text):
    assert fingerprint(text, 3) & (1 << 64) - 1 == brute.simhash(text)


def test_trees_are_deep_and_searches_follow_few_edges(monkeypatch):
    rnd = random.Random(2)
    tree, codes = BKTree(), [rnd.getrandbits(64) for _ in range(4000)]
    for code in codes:
        tree.add(code)
    depth = [0] * len(tree.codes)
    for place, parent in enumerate(tree.parents):
        depth[place] = depth[parent] + 1 if parent >= 0 else 0
    assert max(depth) >= 4
    looked = []

    class Codes(list):
        def __getitem__(self, place):
            looked.append(place)
            return super().__getitem__(place)

    tree.codes = Codes(tree.codes)
    for code in codes[:50]:
        assert codes.index(code) in [codes.index(tree.codes[i]) for i in tree.within(code ^ 5, 2)]
    assert len(looked) < 50 * len(codes) / 3


def test_links_come_from_the_search_alone(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"codes": [[1, 2, 3, 1 << 60, 255]]})
    links = lambda: [b.num_rows for b in simhash._links_inside(2)(iter([batch]))]
    assert links() == [3]
    monkeypatch.setattr(BKTree, "within", lambda self, code, radius: iter(()))
    assert links() == [0]


def test_documents_meet_in_wide_shards(spark):
    """The shards of real codes hold many codes that are not near: the trees have something to tell apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    codes = fingerprints(docs).select("code").distinct()
    sizes = [r.n for r in simhash._filed(codes, 2, 4096).select("key", "n").distinct().collect()]
    assert max(sizes) > 100 and sum(sizes) > 2 * codes.count()


@pytest.mark.parametrize("shard_codes, tree_codes", [(8, 512), (8, 2), (4096, 512), (4096, 4)])
def test_links_connect_all_near_codes(spark, monkeypatch, shard_codes, tree_codes):
    monkeypatch.setattr(simhash, "TREE_CODES", tree_codes)
    rnd = random.Random(3)
    codes = {0}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        codes |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(8)) for _ in range(25)}
    # a crowd that agrees on two blocks and is parted by the third alone
    codes |= {(0x5A5A << 44) | rnd.getrandbits(20) for _ in range(120)}
    signed = {c - (1 << 64) if c >> 63 else c: c for c in codes}
    frame = spark.createDataFrame([(c,) for c in signed], "code bigint")
    roots = {r.node: r.root for r in connected_components(code_links(frame, 2, shard_codes)).collect()}
    wanted = brute.components([(s, c) for s, c in signed.items()])
    assert {(s, roots.get(s, s)) for s in signed} == {(i, top) for i, _, top in wanted}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(None, 4), (7, 7)], "a bigint, b bigint")
    got = connected_components(links).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(1, 301)]


def test_groups_and_kept_rows(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(400)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" end" if i % 2 else ""), "en", "s", 1) for i in range(30)]
    rows += [(40, None, None, None, None), (41, "", "en", "s", 0), (42, "one", "en", "s", 3), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute.components([(r[0], brute.simhash(r[1])) for r in rows])
    extra = spark.createDataFrame([(*r, "x", 1) for r in [*rows, (None, "one", "en", "s", 3)]], SCHEMA + ", fingerprint string, component_id int")
    kept = keep_one(extra)
    assert kept.columns == extra.columns
    best = {r.component_id for r in got}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in best] + [(True, 0)])


def test_of_rows_that_repeat_a_doc_id_one_counts(spark):
    words = lambda seed: " ".join(f"{seed}{i % 37}" for i in range(200))
    rows = [(1, words("b"), "x"), (7, words("a"), "y"), (7, words("b"), "z"), (7, words("b"), "z")]
    kept = sorted((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")).collect())
    # row 7 counts with one of its texts: as a copy of 1 it goes, otherwise it stays
    assert kept in ([(1, words("b"))], [(1, words("b")), (7, words("a"))])
    assert kept == sorted((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, fingerprint string")).collect())


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, brute.simhash(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op1_simhash_groups"](spark, sf).select("doc_id", "fingerprint", "component_id")
    assert {tuple(r) for r in got.collect()} == brute.components(docs)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0

import os
from collections import defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from fleetlens.llm.packing import Encoder
from fleetlens.llm.quality_rules import judge

from . import brute
from .test_secret_scan import base

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality rules"](spark, docs, SF_DIR)
    verdicts = {r.row.doc_id: r.kept for r in judge(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()}
    rows = good.collect()
    assert good.columns == docs.columns and {r.doc_id for r in rows} == {i for i, kept in verdicts.items() if kept}

    one = steps["simhash near-dedup"](spark, good, SF_DIR)
    groups = brute.components([(r.doc_id, brute.simhash(r.text)) for r in rows])
    assert one.columns == docs.columns
    rows = sorted(one.collect())
    assert {r.doc_id for r in rows} == {top for _, _, top in groups}

    cut = steps["substring dedup"](spark, one, SF_DIR)
    wanted = {r.doc_id: (text if gone else r.text) for r, (_, gone, _, text) in zip(rows, brute.removed([r.text for r in rows]))}
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == wanted

    clean = steps["secret scans"](spark, cut, SF_DIR)
    texts = {}
    for r in clean.collect():
        assert (r.text == wanted[r.doc_id]) or "[SECRET]" in r.text
        assert not base(r.text) and (not base(wanted[r.doc_id]) or "[SECRET]" in r.text)
        assert r.text == wanted[r.doc_id] or r.n_chars == len(r.text)
        texts[r.doc_id] = r.text
    assert set(texts) == set(wanted)

    own, pieces = Encoder(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    for r in steps["packing"](spark, clean, SF_DIR).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids = [i for r in sorted(found, key=lambda r: r.start) for i in r.ids]
        assert ids == own.ids(texts[doc_id]).tolist()


def test_edge_tables(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1, "x", 1), (1, text, "en", "s", 1, "x", 1), (2, text, None, None, None, None, None), (None, text + " v", "en", "s", 1, "x", 1), (3, None, "en", "s", 0, "x", 1), (4, "", "en", "s", 0, "x", 1), (5, text[::-1] * 300 + " token = abcdefgh", "en", "s", 1, "x", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name, kept in (("full", rows), ("empty", [])):
        folder = str(tmp_path / name)
        labels.write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(kept, schema).write.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in out} <= {1, None, 5} and bool(out) == bool(kept)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
def test_run_gives_whole_sequences(spark):
    places = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024

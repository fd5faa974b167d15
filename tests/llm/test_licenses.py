import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import licenses, queries
from fleetlens.llm.licenses import BASE, NOTICES, SIMILARITY, SLACK, Template, joined_labels, scan_licenses

SCHEMA = "doc_id bigint, text string, spans int, template string"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_places(text):
    words = words_of(text)
    return sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def plain_spans(text, templates):
    """The same votes, diagonal by diagonal, without tables."""
    words, out = words_of(text), []
    for number, t in enumerate(templates):
        own, votes = t.words, defaultdict(set)
        for d in range(len(words)):
            for p in range(len(own) - t.phrase + 1):
                if d + t.phrase <= len(words) and words[d : d + t.phrase] == own[p : p + t.phrase]:
                    votes[d - p].add(p)
        for d, places in votes.items():
            near = {d} if t.exact else {e for e in votes if abs(e - d) <= SLACK}
            covered = {p + i for e in near for p in votes[e] for i in range(t.phrase)}
            share = len(covered) / len(own)
            if t.exact:
                if share == 1:
                    out.append((d, number, t.label, True, d + len(own), 1.0))
                continue
            beaten = any(len(votes[e]) >= len(places) if e < d else len(votes[e]) > len(places) for e in near - {d})
            if not beaten and share >= SIMILARITY and set(t.must_places) <= covered:
                start, end = min(e + min(votes[e]) for e in near), max(e + max(votes[e]) + t.phrase for e in near)
                out.append((start, number, t.label, False, end, share))
    return sorted(out)


def random_texts():
    rnd = random.Random(6)
    vocabulary = ["GNU", "general", "public", "license", "Apache", "cc", "BY", "mit", "MIT License", "the", "é", "licensed under the", "version", "3", "2.0", "\n", "-"]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60))) for _ in range(150)]
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            own = rnd.choice(BASE + NOTICES).text.split()
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(own) + 1)
                own[at : at + rnd.randrange(3)] = ["word"] * rnd.randrange(3)
            parts += ["lorem"] * rnd.randrange(6) + own
        out.append(" ".join(parts))
    return out


def test_equal_to_the_plain_version(spark):
    texts = random_texts() + [None, "", "mit", "...", "MIT LICENSE", "cc by cc by", "mité license", "cc\x00by"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans]) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        assert got[i] == (len(words_of(t)), plain_spans(t, BASE + NOTICES)), t
    assert sum(len(v[1]) for v in got.values()) > 200


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 1.", "gpl"),
        ("Licensed under CC BY 4.0 or so", "cc-by,cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        ("we talked about the license of the apache people", ""),
        (NOTICES[3].text.replace("furnished to do", "furnished, as it were, to do").replace("obtaining a copy", "obtaining one copy"), "mit"),
        (" ".join(NOTICES[3].text.split()[:30]), ""),
    ],
)
def test_labels(spark, text, labels):
    rows = spark.createDataFrame([(1, text, 0, "")], SCHEMA)
    assert scan_licenses(rows).select(joined_labels(F.col("spans"))).first()[0] == labels


def test_clashing_hashes_give_no_votes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(random_texts()[140:160])], SCHEMA)
    read = lambda: Counter((r.doc_id, r.n_words, str(r.spans)) for r in scan_licenses(rows).collect())
    wanted = read()
    monkeypatch.setattr(licenses, "_hash", lambda words, at, size: F.when(at + size <= F.size(words), F.lit(7).cast("bigint")))
    assert read() == wanted
    monkeypatch.setattr(licenses, "_hash", lambda words, at, size: F.lit(None).cast("bigint"))
    assert all(k[2] == "[]" for k in read())


def test_repeated_rows_long_texts_and_empty_tables(spark):
    long = "the MIT License and " * 20_000
    rows = [(1, "mit license", 0, ""), (1, "mit license", 0, ""), (None, "cc by", 0, ""), (None, "cc by", 0, ""), (None, None, 0, ""), (2, long, 0, "")]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", F.size("spans").alias("n")).collect()
    assert Counter(map(tuple, got)) == Counter({(1, 2, 1): 2, (None, 2, 1): 2, (None, 0, 0): 1, (2, 80_000, 20_000): 1})
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_are_checked(spark):
    rows = spark.createDataFrame([(1, "a b", 0, "")], SCHEMA)
    with pytest.raises(ValueError):
        scan_licenses(rows, [Template("x", "one two")])
    with pytest.raises(ValueError):
        scan_licenses(rows, [Template("x", "word " * (licenses.MOST_TEMPLATE_WORDS + 1))])
    with pytest.raises(ValueError):
        scan_licenses(rows, [Template("x", "a b c d e f", must="g")])


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_license_labels"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_places(texts[r.doc_id])
        places = [p for p, _ in base] or [None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words_of(texts[r.doc_id])), len(base), places[0], places[-1])
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and (r.score == 1.0 if base else 0 <= r.score <= 1)

import gzip
import hashlib
import json

import pytest

from fleetlens.llm import queries
from fleetlens.llm.warc import HTTP_HEAD, archive, inflated, normalise, read_pages, split_records

SCHEMA = "page_id bigint, url string, html string, payload_digest int, path string"


def wanted(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(page_id, first.get(html, page_id))
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        refers = first.get(html)
        refers = None if refers == page_id else refers
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(i, f"http://x/{i}", long, 1, "p") for i in (7, 3, 9)] + [(1, None, None, None, None), (2, "u\r\nX-Page-Id: 9", "", 1, "p")]
    rows += [(4, "u", "x" * 99, 1, "p"), (5, "u", "x" * 99, 1, "p"), (None, "n", long, 1, "p"), (None, "n", "y" * 200, 1, "p"), (3, "again", long, 1, "p")]
    rows += [(100 + i, "big", "z" * 3_000_000 + str(i % 2), 1, "p") for i in range(3)]
    files = archive(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path))
    got = read_pages(files).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == wanted(rows)
    html = {(r[0], r[1]): r[2] for r in rows}
    assert all(r.payload is None or bytes(r.payload).decode() == (html.get((r.page_id, r.url), html.get((r.page_id, "u\r\nX-Page-Id: 9"))) or "") for r in got)
    assert not (tmp_path / "monolithic").exists()
    for r in files.collect():
        data = open(r.path, "rb").read()
        index = [json.loads(x) for x in open(r.path + ".idx")]
        assert len(index) == r.records and sum(x["length"] for x in index) == len(data)
        for x in index:
            assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + x["type"].encode())


def test_several_members_and_torn_files(spark, tmp_path):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(HTTP_HEAD) + 3, HTTP_HEAD + b"abc")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(one + one) + gzip.compress(one))
    files = normalise(spark.createDataFrame([(str(path),)], "path string"), str(tmp_path / "new"))
    assert [r.page_id for r in read_pages(files, payload=False).collect()] == [1, 1, 1]
    path.write_bytes(gzip.compress(one)[:-12])
    with open(path, "rb") as stream, pytest.raises(ValueError):
        list(split_records(inflated(stream)))


def test_empty_table(spark, tmp_path):
    assert read_pages(archive(spark.createDataFrame([], SCHEMA), str(tmp_path))).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.page_id, None, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = queries.QUERIES["op7_warc_records"](spark, sf_dir).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == wanted(rows)

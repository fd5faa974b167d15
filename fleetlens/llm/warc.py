"""WARC archives: writing pages, normalising whole-file gzip streams, and reading records by offset.

A monolithic archive is one gzip stream over all its records, so a record can be reached only by inflating everything
before it. The normaliser inflates each file once, in chunks, writes every record as a gzip member of its own and a
sidecar index with the members' offsets beside it; readers then seek. One file is one task's work at every step; a
repeated task writes under a new name, and only files that a finished task has reported count.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, pin

#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 20
MEMBERS = "path string, records bigint"


def _system(place: str):
    """File system and path of a folder or file that all executors share."""
    from pyarrow import fs

    if place.startswith("file:"):
        place = "/" + place[5:].lstrip("/")
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to`` of every row of ``pages(page_id, url, html)``.

    The payload is the html in UTF-8, a null one empty. Of rows with equal payloads of at least ``least`` bytes those with the
    smallest page_id are responses and others refer to it, rows without page_id too; rows that no page_id leads are responses.
    A repeated row of the smallest page_id is a response again.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("bigint")).withColumn("payload_digest", F.sha2("html", 256))
    long = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
    first = long.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to")
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def _one_line(value: str) -> str:
    """A header value; characters that would end the line are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(row: dict, date: str) -> bytes:
    """The bytes of one record, with the blank lines after it."""
    payload, refers_to = row["html"].encode(), row["refers_to"]
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(row["page_id"], row["payload_digest"]),
        "WARC-Date": date,
        "WARC-Target-URI": None if row["url"] is None else _one_line(row["url"]),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to, row["payload_digest"]),
        "X-Page-Id": row["page_id"],
        "X-Refers-To-Page": refers_to,
        "X-Payload-Length": row["payload_bytes"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in head.items() if value is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str, date: str) -> DataFrame:
    """Write planned records, one gzip stream for each task; ``path, records`` of the files written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, out, deflate = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            for start in range(batch.num_rows):
                if out is None:
                    system, place = _system(path)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                out.write(deflate.compress(record(batch.slice(start, 1).to_pylist()[0], date)))
                n += 1
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return pin(records.mapInArrow(work, MEMBERS))


def inflated(stream) -> Iterator[bytes]:
    """Chunks of an open gzip file, whether one member or several end to end."""
    inflate, fed = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            out = inflate.decompress(data, 4 * CHUNK)
            fed = True
            if out:
                yield out
            if inflate.eof:
                data, inflate, fed = inflate.unused_data, zlib.decompressobj(31), False
            else:
                data = inflate.unconsumed_tail
    if fed and not inflate.eof:
        if out := inflate.flush():
            yield out
        if not inflate.eof:
            raise ValueError("the gzip stream ends before its end mark")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, block and whole bytes of each record of an inflated archive, holding one record at a time."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        if at > CHUNK:
            del held[:at]
            at = 0
        part = next(chunks, None)
        held.extend(part or b"")
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = bytes(held[at:end])
        if not head.strip():
            at = end + 4
            continue
        fields = header_fields(head)
        size = end + 4 - at + int(fields["content-length"]) + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        whole = bytes(held[at : at + size])
        yield fields, whole[len(head) + 4 : -4], whole
        at += size


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.lstrip(b"\r\n").split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.decode().partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named by ``files(path, ...)`` record by record; ``path, records`` of the new ones.

    Beside ``x.warc.gz`` lies ``x.warc.gz.idx``: a line of JSON per record with offset, length, id, type, uri and digest.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                new = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, source = _system(path)
                there, target = _system(new)
                there.create_dir(target.rsplit("/", 1)[0], recursive=True)
                offset = n = 0
                with (
                    system.open_input_stream(source, compression=None) as stream,
                    there.open_output_stream(target, compression=None) as out,
                    there.open_output_stream(f"{target}.idx", compression=None) as index,
                ):
                    for fields, _, whole in split_records(inflated(stream)):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(whole) + deflate.flush()
                        out.write(member)
                        line = {
                            "offset": offset, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"),
                            "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"),
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())], ["path", "records"])

    return pin(files.select("path").mapInArrow(work, MEMBERS))


PAGE = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _page(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(fields[name]) if name in fields else None
    kind, url = fields["warc-type"], fields.get("warc-target-uri")
    if kind == "revisit":
        digest = fields["warc-payload-digest"].partition(":")[2]
        return number("x-page-id"), url, number("x-payload-length"), digest, kind, number("x-refers-to-page"), None
    payload = block.partition(b"\r\n\r\n")[2]
    return number("x-page-id"), url, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, payload


#: Payload bytes of pages that go into one batch.
BATCH_BYTES = 8 << 20


def read_pages(files: DataFrame, payload: bool = True) -> DataFrame:
    """The pages of normalised archives, each record reached by its offset in the index.

    Length and digest of a response are those of the payload read; a revisit has its header's, which are of the full payload, and no payload.
    """
    schema = PAGE if payload else PAGE.rpartition(",")[0]
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*(row[: len(names)] for row in rows)) if rows else ((),) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _system(path)
                rows, size = [], 0
                with system.open_input_stream(f"{place}.idx", compression=None) as index, system.open_input_file(place) as archive:
                    for line in _lines(index):
                        entry = json.loads(line)
                        member = zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31)
                        fields, block, _ = next(split_records(iter([member])))
                        rows.append(_page(fields, block))
                        size += len(block)
                        if size > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return files.select("path").mapInArrow(work, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def archive(pages: DataFrame, folder: str | None = None, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Write all pages, normalise the archives and return the new files as ``path, records``.

    The folder must be shared by all executors; without one, a new folder below the checkpoint folder. The monolithic files are
    deleted once all are rewritten. An empty table writes no file.
    """
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    raw = write_monolithic(plan_records(pages), f"{folder}/monolithic", date)
    done = normalise(raw, f"{folder}/records")
    if not raw.isEmpty():
        system, place = _system(f"{folder}/monolithic")
        system.delete_dir(place)
    return done

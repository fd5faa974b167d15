"""Reading of files by byte ranges that are planned from a listing, so that no file is indexed on the driver.

A listing's row is a file and its length. Files are cut into ranges of bounded length, one row each; ranges are dealt out evenly
and each task reads its ranges. A line belongs to the range in which its first byte lies, so ranges need not know of each other, and
the place of that byte puts the lines of a file in order whatever ranges they were read in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .run_tree import in_batches, is_local

#: Bytes of a range, and bytes read at a time.
SPAN = 64 << 20
CHUNK = 1 << 20
#: What small files cost besides their bytes when they are dealt out.
OPEN_COST = 1 << 16
_END = re.compile(rb"\r\n|\n|\r")


def open_file(path: str):
    """A seekable file; a missing one raises FileNotFoundError."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if is_local(path):
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def lines_between(source, start: int, stop: int, end: int | None = None, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, bool]]:
    """Place, bytes and whether an end of line follows, for each line whose first byte lies from ``start`` to before ``stop``.

    Lines end at ``\\n``, ``\\r\\n`` or ``\\r``. With ``end``, a file that may still grow is read as far as there, and a carriage return
    just before it is no end yet. A line is held whole, the file is not.
    """
    place = max(start - 1, 0)
    source.seek(place)
    data, looked = b"", 0
    # a range that starts inside a line begins after that line's end
    aligned = start == 0
    while True:
        wanted = max(chunk, len(data))
        if end is not None:
            wanted = min(wanted, end - place - len(data))
        more = source.read(wanted) if wanted > 0 else b""
        data += more
        used = 0
        for found in _END.finditer(data, looked):
            # a carriage return at the edge may be the first half of an end of line
            if found.group() == b"\r" and found.end() == len(data) and (more or end is not None):
                break
            if aligned and place + used >= stop:
                return
            if aligned:
                yield place + used, data[used : found.start()], True
            aligned, used = True, found.end()
        if not aligned:
            used = max(len(data) - 1, 0)
        place, data = place + used, data[used:]
        if place >= stop:
            return
        if not more:
            if data and aligned:
                yield place, data, False
            return
        looked = max(len(data) - 1, 0)


_LINES = pa.schema([("path", pa.string()), ("at", pa.int64()), ("line", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    source = open_file(path)
                except FileNotFoundError:  # gone since it was listed
                    continue
                with source:
                    for place, line, _ in lines_between(source, start, stop):
                        yield path, place, line.decode("utf-8", "replace")

    return in_batches(rows(), _LINES)


def cut_ranges(files: DataFrame, span: int = SPAN) -> DataFrame:
    """``path, start, stop`` of the ranges of ``files(path, length)``; an empty file has none."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(span).cast("bigint"))
    cut = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + span, F.col("length")).alias("stop"))


def _tasks(files: DataFrame) -> int:
    """As many tasks as there are spans of bytes, small files counted with the cost of opening them."""
    work = files.agg(F.sum(F.col("length") + OPEN_COST)).first()[0] or 0
    return max(1, min(int(work // SPAN) + 1, 100_000), files.sparkSession.sparkContext.defaultParallelism)


def read_lines(files: DataFrame, span: int = SPAN) -> DataFrame:
    """``path, at, line`` of all lines of ``files(path, length)``; ``at`` is the place of a line's first byte.

    The last line of a file counts with or without an end of line. Bytes that are no UTF-8 are replaced. Bytes written after the listing
    are read only as far as a line begun before goes on; files gone since have no lines. Null paths and lengths are left out.
    """
    known = files.where(F.col("path").isNotNull() & F.col("length").isNotNull()).select("path", "length")
    ranges = cut_ranges(known, span).repartition(_tasks(known), "path", "start")
    return ranges.mapInArrow(_read, "path string, at bigint, line string")


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                with open_file(path) as source:
                    text = source.read().decode("utf-8", "replace")
            except FileNotFoundError:
                continue
            yield pa.RecordBatch.from_pydict({"path": [path], "raw": [text]}, pa.schema([("path", pa.string()), ("raw", pa.string())]))


def read_texts(files: DataFrame) -> DataFrame:
    """``path, raw``: each file of ``files(path, length)`` whole, as one row; an empty file is an empty text."""
    known = files.where(F.col("path").isNotNull()).select("path", "length")
    return known.repartition(_tasks(known), "path").select("path").mapInArrow(_read_whole, "path string, raw string")


def listed_path() -> Column:
    """Path of a row of ``scan_run_files``."""
    return F.concat(F.regexp_replace("run_path", "(?<=.)/$", ""), F.lit("/"), F.col("rel_path"))

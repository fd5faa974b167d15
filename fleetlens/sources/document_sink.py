"""A data source that writes documents as files and commits them as one: ``df.write.format("document_files").mode("append")``.

Tasks write drafts beside the places where documents belong, and note each draft, before they begin it, in a file of the job's folder. The
driver moves the drafts of the tasks that Spark has accepted to their places once all tasks are done. So a job that fails leaves no
document, a task that is repeated or doubled no second one, and readers meet whole documents only. Names of drafts never pass
through the driver's memory as one: a task's message is the name of its file of notes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILES = "config_dir string, file_name string, raw string"
#: Moves under way at a time, and drafts looked at together.
MOVERS, TOGETHER = 16, 1000


def place_of(directory: str):
    """File system and folder of a path or URI."""
    from pyarrow import fs

    if directory.startswith("file:"):
        directory = "/" + directory[5:].lstrip("/")
    if "://" not in directory:
        return fs.LocalFileSystem(), directory
    return fs.FileSystem.from_uri(directory)


@dataclass
class Drafts(WriterCommitMessage):
    """The notes of one task that is done, and how many drafts they name."""

    notes: str
    written: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, job: str, overwrite: bool) -> None:
        self.job, self.overwrite = job, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        notes, count = f"notes-{uuid.uuid4().hex}", 0
        system, folder = place_of(self.job)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{notes}") as noted:
            for batch in iterator:
                columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("config_dir", "file_name", "raw"))
                count += sum(self._draft(noted, *row) for row in zip(*columns))
        return Drafts(notes, count)

    def _draft(self, noted, directory: str, name: str, raw: str) -> bool:
        system, folder = place_of(directory)
        if not self.overwrite and _exists(system, os.path.join(folder, name)):
            return False
        draft = f".{name}.{uuid.uuid4().hex}"
        noted.write((json.dumps([directory, name, draft]) + "\n").encode())
        noted.flush()
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(os.path.join(folder, draft)) as out:
            out.write((raw or "").encode())
        return True

    def commit(self, messages: list[Drafts | None]) -> None:
        good = {m.notes for m in messages if m is not None}
        moved = 0
        for notes, draft in self._noted():
            moved += sum(self.movers(_move if notes in good else _drop, draft, self.overwrite))
        system, folder = place_of(self.job)
        with system.open_output_stream(f"{folder}/committed") as out:
            out.write(str(moved).encode())

    def abort(self, messages: list[Drafts | None]) -> None:
        for _, draft in self._noted():
            list(self.movers(_drop, draft, False))

    def movers(self, action, drafts: list, overwrite: bool) -> Iterator[bool]:
        with ThreadPoolExecutor(MOVERS) as pool:
            yield from pool.map(lambda d: action(*d, overwrite), drafts)

    def _noted(self) -> Iterator[tuple[str, list]]:
        """Drafts of all tasks of the job, those lost too, some at a time."""
        from pyarrow import fs

        system, folder = place_of(self.job)
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if not info.base_name.startswith("notes-"):
                continue
            with system.open_input_stream(info.path) as stream:
                # a note that a lost task has not finished names no draft
                whole = (json.loads(line) for line in _lines(stream) if line.endswith(b"\n"))
                while some := list(islice(whole, TOGETHER)):
                    yield info.base_name, some


def _lines(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(chunk):
        *lines, rest = (rest + data).split(b"\n")
        yield from (line + b"\n" for line in lines)
    if rest:
        yield rest


def _exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


def _move(directory: str, name: str, draft: str, overwrite: bool) -> bool:
    """Put a draft in its place, unless a document has come there in the meantime; a commit that is repeated finds nothing left to do."""
    system, folder = place_of(directory)
    own, target = os.path.join(folder, draft), os.path.join(folder, name)
    if not _exists(system, own):
        return False
    if not overwrite and _exists(system, target):
        system.delete_file(own)
        return False
    system.move(own, target)
    return True


def _drop(directory: str, name: str, draft: str, overwrite: bool) -> bool:
    system, folder = place_of(directory)
    own = os.path.join(folder, draft)
    if _exists(system, own):
        system.delete_file(own)
    return False


class DocumentFiles(DataSource):
    """Options: ``job`` (a folder of its own in the shared folder) and ``overwrite`` (``false``: documents that are there stay)."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["job"], self.options.get("overwrite", "false").lower() == "true")


def committed(job: str) -> int:
    """How many documents a job has put in their places."""
    system, folder = place_of(job)
    with system.open_input_stream(f"{folder}/committed") as count:
        return int(count.read())

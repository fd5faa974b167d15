"""A data source for directory trees: ``spark.read.format("run_tree").option("roots", json).load()``.

Spark's file sources leave out empty files and directories, both of which carry run state, and index all files on the
driver. This source plans directories instead: the driver opens directories from the roots down until there are
enough of them for all tasks (names of directories only), and deals them out in many small shards, so that a task that is done takes the
next shard. A task walks its directories, entry by entry, and holds no more than the names of directories still to be opened.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRIES = "root string, directory string, file_name string, is_dir boolean, length bigint, error string"
_ARROW = pa.schema(
    [("root", pa.string()), ("directory", pa.string()), ("file_name", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("error", pa.string())]
)
BATCH = 10_000


def is_local(path: str) -> bool:
    return "://" not in path


def local_entries(directory: str) -> Iterator[tuple[str, bool, int]]:
    """Name, kind and size of each entry, as the system gives them, without a list of them."""
    try:
        scan = os.scandir(directory)
    except (FileNotFoundError, NotADirectoryError):
        return
    with scan:
        for entry in scan:
            try:
                is_dir = entry.is_dir()
                size = 0 if is_dir else entry.stat().st_size
            except FileNotFoundError:  # a dangling link, or gone since
                continue
            yield entry.name, is_dir, size


def remote_entries(directory: str) -> Iterator[tuple[str, bool, int]]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(directory)
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        is_dir = info.type == fs.FileType.Directory
        yield info.base_name, is_dir, 0 if is_dir else info.size


def entries(directory: str) -> Iterator[tuple[str, bool, int]]:
    return local_entries(directory) if is_local(directory) else remote_entries(directory)


def loops_back(path: str, above: tuple[str, ...]) -> bool:
    """Whether a directory is one of those on the way to it, or holds one of them: going in would come back here."""
    target = os.path.join(os.path.realpath(path), "")
    return any(os.path.join(held, "").startswith(target) for held in above)


def plain_root(root: str) -> str:
    """A root without slashes at its end, and without the scheme of local files."""
    return re.sub("(?<=.)/+$", "", re.sub("^file:/+", "/", root))


@dataclass(frozen=True)
class Place:
    """A directory, the root it was reached from, and the resolved directories on the way to it."""

    root: str
    directory: str
    above: tuple[str, ...] = ()

    def inside(self, part: int = 0, parts: int = 1) -> Iterator[tuple[Place | None, str, bool, int]]:
        """Entries, each directory with its own place; of several ``parts``, dealt out by name, only one.

        Linked directories are left out where they lead back to their way down.
        """
        local = is_local(self.directory)
        # links can lead anywhere, so the way to a directory is kept as resolved paths
        way = (*self.above, os.path.realpath(self.directory)) if local else ()
        for name, is_dir, size in entries(self.directory):
            if parts > 1 and zlib.crc32(os.fsencode(name)) % parts != part:
                continue
            path = f"{self.directory.rstrip('/')}/{name}"
            if not is_dir:
                yield None, name, False, size
            elif not local or not loops_back(path, way):
                yield Place(self.root, path, way), name, True, 0


@dataclass
class Shard(InputPartition):
    """Directories to walk down, directories of which only the own entries are wanted, and parts of wide ones to walk down."""

    deep: list[Place]
    flat: list[Place]
    wide: list[tuple[Place, int, int]]


#: Directories below one directory up to which the driver holds their names; wider ones are dealt out to tasks in parts of about as many.
WIDE = 20_000


def plan_shards(roots: list[str], shards: int) -> list[Shard]:
    """Directories opened breadth first until there are ``shards`` to walk down, dealt out in turn."""
    waiting, opened, wide = deque(Place(root, root) for root in roots), [], []
    while waiting and len(waiting) + len(wide) < shards:
        place = waiting.popleft()
        below, n = [], 0
        try:
            for inner, *_ in place.inside():
                if inner is not None:
                    n += 1
                    if n <= WIDE:
                        below.append(inner)
        except PermissionError:
            pass  # the task that lists it reports it
        if n > WIDE:
            parts = -(-n // WIDE)
            wide += [(place, part, parts) for part in range(parts)]
        else:
            opened.append(place)
            waiting.extend(below)
    deep = list(waiting)
    n = min(shards, max(len(deep), len(opened), len(wide), 1))
    return [Shard(deep[i::n], opened[i::n], wide[i::n]) for i in range(n)]


def walk(shard: Shard) -> Iterator[tuple]:
    """Rows of the entries of a shard."""
    todo = [(place, False, 0, 1) for place in shard.flat] + [(place, True, 0, 1) for place in shard.deep]
    todo += [(place, True, part, parts) for place, part, parts in shard.wide]
    while todo:
        place, down, part, parts = todo.pop()
        try:
            for below, name, is_dir, size in place.inside(part, parts):
                yield place.root, place.directory, name, is_dir, size, None
                if down and below is not None:
                    todo.append((below, True, 0, 1))
        except PermissionError as refused:
            yield place.root, place.directory, None, False, 0, str(refused)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], shards: int) -> None:
        self.roots, self.shards = roots, shards

    def partitions(self) -> list[Shard]:
        return plan_shards(self.roots, self.shards)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return in_batches(walk(partition), _ARROW)


class RunTree(DataSource):
    """Options: ``roots`` (a JSON list of directories; a missing one has no rows) and ``shards`` (64)."""

    @classmethod
    def name(cls) -> str:
        return "run_tree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        roots = json.loads(self.options.get("roots", "[]"))
        shards = int(self.options.get("shards", "64"))
        if shards < 1:
            raise ValueError("shards must be 1 at least")
        return _Reader([plain_root(root) for root in roots], shards)

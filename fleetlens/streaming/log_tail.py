"""A streaming data source that reads growing logs on: each complete line once, whenever it is written.

    spark.readStream.format("log_tail").option("roots", json).option("state", shared_folder).load()

The offset of the stream is the number of a snapshot. A snapshot holds the byte offset up to which each log is read: path and size of
every log file, written in the state folder in a file per shard (a shard is a hash of the path). A batch from snapshot j to k
has a task per shard, which compares the two files of its shard and reads what was added. Offsets are never held together, on the driver
or anywhere; as a snapshot does not change once it has its number, a repeated task or a restarted stream reads the same lines again.

A file longer than a range has its offset in a file of its own kind, and is read by a task per range, so that one log which holds most of all
bytes is shared by many tasks.

Logs must lie on a file system that the driver and all executors have mounted, as run directories of computing sites do.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.logs import LOG_GLOB
from ..functions.paths import base_name, parent_path, path_in_run, run_of_file
from ..sources.ranges import SPAN, lines_between
from ..sources.run_files import glob_pattern
from ..sources.run_tree import Place, in_batches, plain_root

LINES = "path string, at bigint, line string"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("line", pa.string())])
SHARDS = 64
_BLOCK = 1 << 16


def end_of_last_line(source, size: int) -> int:
    """Place after the last end of line among the first ``size`` bytes, 0 if there is none."""
    stop = size
    while stop > 0:
        start = max(0, stop - _BLOCK)
        source.seek(start)
        block = source.read(stop - start)
        feed, back = block.rfind(b"\n"), block.rfind(b"\r")
        if start + back == size - 1 and feed < back:  # may be the first half of an end of line
            back = block.rfind(b"\r", 0, back)
        if max(feed, back) >= 0:
            return start + max(feed, back) + 1
        stop = start
    return 0


def added_lines(path: str, before: int, size: int, start: int | None = None, stop: int | None = None) -> Iterator[tuple[str, int, str]]:
    """Lines completed after the first ``before`` of ``size`` bytes, of those that begin from ``start`` to before ``stop``."""
    try:
        source = open(path, "rb")
    except FileNotFoundError:
        return
    with source:
        if start is None:
            start = end_of_last_line(source, before)
        for at, line, ended in lines_between(source, start, size if stop is None else stop, size):
            if ended:
                yield path, at, line.decode("utf-8", "replace")


class Snapshots:
    """Numbered snapshots in the state folder; number 0 is the empty one, which has no folder."""

    def __init__(self, folder: str, shards: int, span: int) -> None:
        self.folder, self.shards, self.span = folder, shards, span

    def place(self, number: int) -> str:
        return f"{self.folder}/snapshot-{number}"

    def last(self) -> int:
        found = [int(name.rpartition("-")[2]) for name in os.listdir(self.folder) if re.fullmatch(r"snapshot-\d+", name)]
        return max(found, default=0)

    def mark(self, number: int) -> str:
        """Fingerprint of a snapshot."""
        return open(f"{self.place(number)}/mark").read() if number else "0 0"

    def sizes(self, number: int, part: str) -> dict[str, int]:
        """Path and size of the files of one part (a shard, or ``long``)."""
        if number == 0:
            return {}
        if not os.path.isdir(self.place(number)):
            raise FileNotFoundError(f"snapshot {number} is gone from {self.folder}")
        with open(f"{self.place(number)}/{part}") as lines:
            return dict(map(json.loads, lines))

    def shard_of(self, path: str) -> str:
        return f"shard-{zlib.crc32(path.encode('utf-8', 'surrogateescape')) % self.shards}"

    def take(self, files: Iterator[tuple[str, int]]) -> int:
        """Number of a snapshot of these files: a new one, or the last if it holds the same."""
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        os.makedirs(draft)
        outs = {part: open(f"{draft}/{part}", "w") for part in ["long", *(f"shard-{i}" for i in range(self.shards))]}
        total, count = 0, 0
        for path, size in files:
            line = json.dumps([path, size])
            total += int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest())
            count += 1
            outs["long" if size > self.span else self.shard_of(path)].write(line + "\n")
        for out in outs.values():
            out.close()
        mark, last = f"{count} {total % (1 << 64)}", self.last()
        if mark == self.mark(last):
            shutil.rmtree(draft)
            return last
        with open(f"{draft}/mark", "w") as out:
            out.write(mark)
        os.rename(draft, self.place(last + 1))
        return last + 1

    def drop_before(self, number: int) -> None:
        for name in os.listdir(self.folder):
            if re.fullmatch(r"snapshot-\d+", name) and int(name.rpartition("-")[2]) < number:
                shutil.rmtree(f"{self.folder}/{name}")


def log_files(roots: list[str], pattern: str) -> Iterator[tuple[str, int]]:
    """Path and size of every log below the roots, none held but the directories still to be opened."""
    todo = [Place(root, root) for root in roots]
    while todo:
        try:
            for below, name, is_dir, size in (place := todo.pop()).inside():
                if below is not None:
                    todo.append(below)
                elif not is_dir and re.match(pattern, name):
                    yield f"{place.directory.rstrip('/')}/{name}", size
        except PermissionError:
            continue


@dataclass
class ShardPart(InputPartition):
    start: int
    end: int
    shard: str


@dataclass
class LongPart(InputPartition):
    """The part from ``start`` to before ``stop`` of what was added to a long file; ``before`` is null if it was short then.

    To the ``first`` part belongs the line that was not complete at the earlier snapshot, wherever it begins.
    """

    first: bool
    earlier: int
    path: str
    before: int | None
    size: int
    start: int
    stop: int


class _Reader(DataSourceStreamReader):
    def __init__(self, roots: list[str], pattern: str, snapshots: Snapshots) -> None:
        self.roots, self.pattern, self.snapshots = roots, pattern, snapshots

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": self.snapshots.take(log_files(self.roots, self.pattern))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        earlier, later = start["snapshot"], end["snapshot"]
        if earlier == later:
            return []
        parts: list[InputPartition] = [ShardPart(earlier, later, f"shard-{i}") for i in range(self.snapshots.shards)]
        had = self.snapshots.sizes(earlier, "long")
        for path, size in self.snapshots.sizes(later, "long").items():
            before = had.get(path)
            if before == size:
                continue
            # cut from the start of the file on; of the first part the task finds where it begins
            first = before if before is not None and before < size else 0
            cuts = [*range(first, size, self.snapshots.span), size]
            known = before if before is None or before < size else 0
            parts += [LongPart(a == first, earlier, path, known, size, a, b) for a, b in zip(cuts, cuts[1:])]
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return in_batches(self._rows(partition), _ARROW)

    def _rows(self, part: InputPartition) -> Iterator[tuple[str, int, str]]:
        if isinstance(part, ShardPart):
            had = self.snapshots.sizes(part.start, part.shard)
            for path, size in self.snapshots.sizes(part.end, part.shard).items():
                before = had.get(path, 0)
                if before != size:
                    yield from added_lines(path, before if before < size else 0, size)
            return
        before = part.before
        if before is None:
            before = self.snapshots.sizes(part.earlier, self.snapshots.shard_of(part.path)).get(part.path, 0)
        yield from added_lines(part.path, before, part.size, None if part.first else part.start, part.stop)

    def commit(self, end: dict) -> None:
        self.snapshots.drop_before(end["snapshot"])


class LogTail(DataSource):
    """Options: ``roots`` (JSON list), ``state`` (a folder that all machines share), ``glob``, ``shards`` and ``span`` (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        roots = sorted({plain_root(root) for root in json.loads(self.options["roots"])})
        # a root below another one adds nothing
        roots = [r for r in roots if not any(r != other and r.startswith(other.rstrip("/") + "/") for other in roots)]
        state = plain_root(self.options["state"])
        os.makedirs(state, exist_ok=True)
        patterns = [glob_pattern(one) for one in self.options.get("glob", LOG_GLOB).strip("{}").split(",")]
        shards, span = int(self.options.get("shards", SHARDS)), int(self.options.get("span", SPAN))
        if shards < 1 or span < 1:
            raise ValueError("shards and span must be 1 at least")
        return _Reader(roots, "|".join(patterns), Snapshots(state, shards, span))


def tail_log_lines(spark: SparkSession, roots: list[str], state: str, glob: str = LOG_GLOB, shards: int = SHARDS, span: int = SPAN) -> DataFrame:
    """A stream of ``run_path, file_name, line_no, line``: the complete lines of logs below ``roots``, each once, also of logs that grow.

    ``line_no`` is the place of the line's first byte, so it orders the lines of a file however they arrive. A line is given when its
    end has been written. A log that becomes shorter is read from its start again. The ``state`` folder must be shared, and belongs to one stream:
    restart the stream with the same folder and checkpoint.
    """
    spark.dataSource.register(LogTail)
    options = {"roots": json.dumps(roots), "state": state, "glob": glob, "shards": str(shards), "span": str(span)}
    lines = spark.readStream.format("log_tail").options(**options).load()
    directory = parent_path("path")
    return lines.select(
        run_of_file(directory).alias("run_path"),
        path_in_run(directory, base_name("path")).alias("file_name"),
        F.col("at").alias("line_no"),
        "line",
    )

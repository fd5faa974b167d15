"""Listing of run trees as a table."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_in_run, run_of_file
from ..session import pin
from .run_tree import RunTree

#: Shards of directories for each task that can run at a time.
SHARDS_PER_TASK = 8


def scan_run_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every file and directory below ``roots`` (POSIX paths or URIs Arrow can open), empty ones included.

    Files in an ``outputs`` directory belong to the run directory above it. Linked directories are followed unless they
    lead back to their own way down. A directory that may not be read is one row without a file name, with its ``error``.
    The tree is listed once and kept in the checkpoint folder: all that follows sees the same state of a tree that may be growing.
    """
    spark.dataSource.register(RunTree)
    shards = SHARDS_PER_TASK * max(spark.sparkContext.defaultParallelism, 1)
    found = pin(spark.read.format("run_tree").option("roots", json.dumps(roots)).option("shards", str(shards)).load())
    directory = F.regexp_replace("directory", "(?<=.)/$", "")
    return found.select(
        "root",
        run_of_file(directory).alias("run_path"),
        path_in_run(directory, F.col("file_name")).alias("rel_path"),
        "file_name",
        "is_dir",
        "length",
        "error",
    )


def glob_pattern(glob: str) -> str:
    """Regular expression of a simple glob (``*`` and ``?`` within one path part)."""
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "$"


def scan_forcing_files(spark: SparkSession, root: str, glob_1: str = "*_1.*", glob_2: str = "*_2.*") -> DataFrame:
    """``(stream, path, length)`` of a forcing directory's files, split in two streams by glob."""
    files = scan_run_files(spark, [root]).where(~F.col("is_dir"))
    path = F.concat("run_path", F.lit("/"), "rel_path")
    below = F.substr(path, F.length("root") + 2)
    first, second = below.rlike(glob_pattern(glob_1)), below.rlike(glob_pattern(glob_2))
    streams = F.array_compact(F.array(F.when(first, F.lit(1)), F.when(second, F.lit(2))))
    return files.select(F.explode(streams).alias("stream"), path.alias("path"), "length")

"""Line-by-line comparison of two file trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY = r"\.(h5|nc)$"


def _matches(path: Column, mask: str) -> Column:
    return path.contains(mask) | path.rlike("^(?:" + mask + ")")


def diff_trees(test: DataFrame, reference: DataFrame, skip: dict[str, list[int]] | None = None) -> DataFrame:
    """``(rel_path, line_no, test_line, reference_line)`` of every line that differs.

    Only files of the reference tree count. ``skip`` names, per file mask (a part of the path or
    a pattern at its start), line positions from 0 left out on both sides; a position wraps
    around the test file's length, so -1 is its last line.
    """
    wanted = reference.select("rel_path").distinct()
    left = test.join(wanted, "rel_path", "left_semi").where(~F.col("rel_path").rlike(BINARY))
    right = reference.where(~F.col("rel_path").rlike(BINARY))
    joined = left.select("rel_path", "line_no", F.col("line").alias("test_line")).join(
        right.select("rel_path", "line_no", F.col("line").alias("reference_line")), ["rel_path", "line_no"], "full_outer"
    )
    differing = joined.where(~F.col("test_line").eqNullSafe(F.col("reference_line")))
    if skip:
        path = F.col("rel_path")
        masked = reduce(lambda a, b: a | b, [_matches(path, mask) for mask in skip])
        lengths = left.where(masked).groupBy("rel_path").agg(F.count(F.lit(1)).alias("_n"))
        index = F.col("line_no") - 1
        hit = reduce(
            lambda a, b: a | b,
            [_matches(path, mask) & (index == F.pmod(F.lit(i), F.col("_n"))) for mask, at in skip.items() for i in at],
        )
        differing = differing.join(lengths, "rel_path", "left").where(~F.coalesce(hit, F.lit(False))).drop("_n")
    return differing.select("rel_path", "line_no", "test_line", "reference_line")


def diff_sizes(test_files: DataFrame, reference_files: DataFrame) -> DataFrame:
    """``(rel_path, test_length, reference_length)`` of binary files of unequal size, and of files not there."""
    pairs = reference_files.where(~F.col("is_dir")).select("rel_path", F.col("length").alias("reference_length")).join(
        test_files.where(~F.col("is_dir")).select("rel_path", F.col("length").alias("test_length")), "rel_path", "left"
    )
    unequal = F.col("rel_path").rlike(BINARY) & (F.col("test_length") != F.col("reference_length"))
    return pairs.where(F.col("test_length").isNull() | unequal).select("rel_path", "test_length", "reference_length")

"""Boundaries of mesh files, found from the counts that head their blocks.

The tail of a mesh has two sections, open and land. Each starts with the number of its boundaries and a node total; then come the
blocks, a header with the number of nodes and a line per node. A header tells where the next one is, but only the first is known
to be a header. So every line is taken as one, and its pointer to the next is doubled: after n joins the pointers span 2^n blocks
and all headers among the first 2^n are known. Joins are on mesh and line, so the lines of one mesh spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import rank_within
from ..session import pin

#: Nodes of a block that one row stands for before they are listed.
PIECE = 1 << 16
_INTEGER = r"^-?[0-9]+$"


def read_boundaries(tail: DataFrame) -> DataFrame:
    """``mesh_id, is_open, boundary_id, boundary_type, pos, node_id`` of tails ``(mesh_id, line_no, w)``, ``w`` the words of a line.

    Lines that do not start with an integer count for nothing. Boundaries are numbered within their section and nodes within their
    boundary, from 1; only land boundaries have a type. Of a tail that breaks off the nodes that are there are given. A
    count that is negative or too large for a long ends the tail of its mesh.
    """
    whole = lambda i: F.when(F.get("w", F.lit(i)).rlike(_INTEGER), F.get("w", F.lit(i)))
    numbers = tail.where(whole(0).isNotNull()).select(
        "mesh_id", "line_no", whole(0).try_cast("bigint").alias("number"), whole(1).try_cast("int").alias("kind")
    )
    lines = pin(rank_within(numbers, ["mesh_id"], [F.col("line_no")], "at").select("mesh_id", "at", "number", "kind"))
    last = lines.agg(F.max("at")).first()[0] or 0
    # a pointer beyond the line after the last leads nowhere
    jumps = lines.where(f"number BETWEEN 0 AND {last} - at").select("mesh_id", "at", (F.col("at") + F.col("number") + 1).alias("next"))

    opened = _follow(jumps, _sections(lines.where("at = 1")), last)
    ends = opened.where("passed = blocks").select("mesh_id", "at")
    landed = _follow(jumps, _sections(lines.join(ends, ["mesh_id", "at"])), last)
    headers = opened.withColumn("is_open", F.lit(True)).unionByName(landed.withColumn("is_open", F.lit(False)))
    return _nodes(lines, headers.where("passed < blocks"), last)


def _sections(counts: DataFrame) -> DataFrame:
    """Where the first header of each section is, from the line with its count; the node total between them is not needed."""
    return counts.select("mesh_id", (F.col("at") + 2).alias("at"), F.col("number").alias("blocks")).where("blocks >= 0")


def _follow(jumps: DataFrame, starts: DataFrame, last: int) -> DataFrame:
    """``starts`` and the lines that pointers lead to from there, up to ``blocks`` of them; ``passed`` counts them.

    Only the largest number of blocks comes to the driver, to tell how often to double.
    """
    reached = pin(starts.withColumn("passed", F.lit(0).cast("bigint")))
    most = min(reached.agg(F.max("blocks")).first()[0] or 0, last)
    step = 1
    while step <= most:
        ahead = reached.where(F.col("passed") + step <= F.col("blocks")).join(jumps, ["mesh_id", "at"])
        ahead = ahead.select("mesh_id", F.col("next").alias("at"), "blocks", (F.col("passed") + step).alias("passed"))
        reached = pin(reached.unionByName(ahead))
        step *= 2
        if step <= most:
            second = jumps.select("mesh_id", F.col("at").alias("next"), F.col("next").alias("after"))
            jumps = pin(jumps.join(second, ["mesh_id", "next"]).select("mesh_id", "at", F.col("after").alias("next")))
    return reached


def _nodes(lines: DataFrame, headers: DataFrame, last: int) -> DataFrame:
    """The lines below each header. A block is listed in pieces, so that no row holds all of a long one."""
    blocks = headers.join(lines, ["mesh_id", "at"]).select(
        "mesh_id",
        "is_open",
        (F.col("passed") + 1).cast("int").alias("boundary_id"),
        F.when(~F.col("is_open"), F.col("kind")).alias("boundary_type"),
        F.col("at").alias("head"),
        F.least("number", F.lit(last) - F.col("at")).alias("size"),
    )
    pieces = blocks.where("size > 0").withColumn("piece", F.expr(f"explode(sequence(0L, (size - 1) div {PIECE}))"))
    listed = pieces.withColumn("pos", F.expr(f"explode(sequence(piece * {PIECE} + 1, least(size, (piece + 1) * {PIECE})))"))
    placed = listed.withColumn("at", F.col("head") + F.col("pos")).join(lines.select("mesh_id", "at", "number"), ["mesh_id", "at"])
    return placed.select(
        "mesh_id", "is_open", "boundary_id", "boundary_type", F.col("pos").cast("int").alias("pos"), F.col("number").alias("node_id")
    )

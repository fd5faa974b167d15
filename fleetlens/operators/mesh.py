"""Meshes: equality and nodal attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_mesh(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``(mesh_id, mismatches, is_same)`` comparing two sets of nodes or elements row by row."""
    l = left.select("mesh_id", *key, F.struct(*values).alias("_l"))
    r = right.select("mesh_id", *key, F.struct(*values).alias("_r"))
    differs = ~F.col("_l").eqNullSafe(F.col("_r"))
    return (
        l.join(r, ["mesh_id", *key], "full_outer")
        .groupBy("mesh_id")
        .agg(F.count_if(differs).alias("mismatches"))
        .withColumn("is_same", F.col("mismatches") == 0)
    )


def mesh_prints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(mesh_id, rows, print)``: a fingerprint of each mesh's rows as a multiset, whatever their order.

    Sums of the halves of two independent hashes of every row, and the number of rows. They are taken before the shuffle, so a mesh of any
    size moves one row per task. Sums of 32 bits stay whole up to 2**31 rows a mesh.
    """
    row = F.struct(*columns)
    halves = []
    for h in (F.xxhash64(row), F.xxhash64(F.lit("second"), row)):
        halves += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))]
    return rows.groupBy("mesh_id").agg(F.count("*").alias("rows"), *(s.alias(f"s{i}") for i, s in enumerate(halves))).select(
        "mesh_id", "rows", F.struct("s0", "s1", "s2", "s3").alias("print")
    )


def mesh_classes(rows: DataFrame, columns: list[str], confirm: bool = True) -> DataFrame:
    """``(mesh_id, class_id, members)`` of all meshes of a fleet: equal ones have one class, named by its smallest mesh.

    ``rows`` are the nodes or elements of all meshes, equal when all ``columns`` are (null equals null), in any order, repeats counted. Meshes
    are grouped by fingerprints, one row each; no pairs of meshes are made. With ``confirm`` each mesh is then compared with the first
    of its class row by row, and one whose rows differ all the same is a class of its own.
    """
    prints = mesh_prints(rows, columns)
    first = prints.groupBy("rows", "print").agg(F.min("mesh_id").alias("class_id"))
    classes = prints.join(first, ["rows", "print"]).select("mesh_id", "class_id")
    if confirm:
        classes = _confirmed(rows, columns, classes)
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("members"))
    return classes.join(sizes, "class_id").select("mesh_id", "class_id", "members")


def _confirmed(rows: DataFrame, columns: list[str], classes: DataFrame) -> DataFrame:
    """Classes in which every mesh has the very rows of the first one."""
    key = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]
    names = [f"_{i}" for i in range(len(columns))]
    counted = rows.groupBy("mesh_id", *key).agg(F.count("*").alias("_n"))
    others = classes.where("mesh_id <> class_id")
    mine = counted.join(others, "mesh_id")
    firsts = counted.join(others.select("class_id").distinct(), F.col("mesh_id") == F.col("class_id"), "left_semi")
    theirs = firsts.select(F.col("mesh_id").alias("_first"), *[F.col(c).alias(f"f{c}") for c in names], F.col("_n").alias("_m"))
    equal = (F.col("class_id") == F.col("_first")) & (F.col("_n") == F.col("_m"))
    for c in names:
        equal = equal & F.col(c).eqNullSafe(F.col(f"f{c}"))
    # as both have as many rows, a row too many in the first one is a row without partner in the other
    wrong = mine.join(theirs, equal, "left_anti").select("mesh_id").distinct().withColumn("_wrong", F.lit(True))
    return classes.join(wrong, "mesh_id", "left").select(
        "mesh_id", F.when(F.col("_wrong"), F.col("mesh_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def dense_attributes(nodes: DataFrame, defaults: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``(mesh_id, attribute, node_id, value)`` for every node: its exception or the attribute's default.

    ``value`` may be of any type; where the tables have ``values``, arrays of one or more numbers, those are spread as they are.
    """
    held = "values" if "values" in defaults.columns else "value"
    spread = nodes.select("mesh_id", "node_id").join(
        defaults.select("mesh_id", "attribute", F.col(held).alias("_default")), "mesh_id"
    )
    return spread.join(
        exceptions.select("mesh_id", "attribute", "node_id", F.col(held).alias("_given"), F.lit(True).alias("_has")),
        ["mesh_id", "attribute", "node_id"],
        "left",
    ).select(
        "mesh_id",
        "attribute",
        "node_id",
        F.when(F.col("_has"), F.col("_given")).otherwise(F.col("_default")).alias(held),
    )


def without_attributes(nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Warnings: meshes with nodes but no nodal attributes."""
    return nodes.select("mesh_id").distinct().join(defaults.select("mesh_id"), "mesh_id", "left_anti")

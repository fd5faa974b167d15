"""Order of jobs and components that wait for one another, found by rounds of joins over all configurations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin


def submission_levels(edges: DataFrame, scope: str = "config_dir", src: str = "src_job", dst: str = "dst_job") -> DataFrame:
    """``(scope, name, level)`` of every name in ``edges``: 0 waits for nothing, each other for names of lower levels only.

    ``level`` is the number of edges on the longest way to the name within its scope, so all names of a level can be submitted at once. It is null
    for names that wait for a cycle or lie on one: they can never start. Edges with a null end are left out, an edge
    that is given twice counts once, an edge from a name to itself is a cycle.

    Each round takes the names that wait for nothing left and their edges away, for all scopes together: an anti-join and two counts on equal
    keys. There are as many rounds as the longest way has edges.
    """
    plain = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    left = pin(plain.select(F.col(scope).alias("_scope"), F.col(src).alias("_src"), F.col(dst).alias("_dst")).distinct())
    names = left.select("_scope", F.explode(F.array("_src", "_dst")).alias("_name")).distinct()
    levels, level = [], 0
    open_names = pin(names)
    while not open_names.isEmpty():
        waiting = left.select("_scope", F.col("_dst").alias("_name"))
        ready = _minus(open_names, waiting).withColumn("level", F.lit(level))
        ready = pin(ready)
        if ready.isEmpty():
            break
        levels.append(ready)
        open_names = pin(_minus(open_names, ready))
        left = pin(_minus(left.withColumnRenamed("_src", "_name"), ready).withColumnRenamed("_name", "_src"))
        level += 1
    found = open_names.withColumn("level", F.lit(None).cast("int"))
    for part in levels:
        found = found.unionByName(part)
    return found.select(F.col("_scope").alias(scope), F.col("_name").alias("name"), "level")


def _minus(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose scope (null-safe) and name are not in ``gone``."""
    other = gone.select(F.col("_scope").alias("_s"), F.col("_name").alias("_n")).distinct()
    return rows.join(other, F.col("_scope").eqNullSafe(F.col("_s")) & (F.col("_name") == F.col("_n")), "left_anti")


def cycle_problems(edges: DataFrame, scope: str = "config_dir", src: str = "src_job", dst: str = "dst_job") -> DataFrame:
    """``(scope, src, dst)`` of the edges that lie on or between cycles: each end both waits for a cycle and is waited for by one.

    Taking names away from both ends, those that wait for nothing left and those that nothing left waits for, leaves these edges. A plan
    without cycles has none.
    """
    forward = submission_levels(edges, scope, src, dst).where("level IS NULL").select(scope, "name")
    backward = submission_levels(edges, scope, dst, src).where("level IS NULL").select(scope, "name")
    stuck = forward.intersect(backward).select(F.col(scope).alias("_scope"), F.col("name").alias("_name"))
    kept = edges.select(scope, src, dst).distinct()
    for end in (src, dst):
        both = F.col(scope).eqNullSafe(F.col("_scope")) & (F.col(end) == F.col("_name"))
        kept = kept.join(stuck, both, "left_semi")
    return kept


def submission_order(edges: DataFrame, scope: str = "config_dir", src: str = "src_job", dst: str = "dst_job") -> DataFrame:
    """``(scope, name, level, place)``: the order in which a scope's names can be submitted one after the other, from 1.

    Names that cannot start have neither level nor place. Within a level names go by the alphabet. A scope's names are those
    of one configuration; a level of a huge configuration is ranked in one task.
    """
    levels = submission_levels(edges, scope, src, dst)
    sizes = levels.where("level IS NOT NULL").groupBy(scope, "level").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(scope).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col(scope).alias("_scope"), F.col("level").alias("_level"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(scope, "level").orderBy("name"))
    same = F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("level") == F.col("_level"))
    placed = levels.withColumn("_rank", inside).join(shifts, same, "left")
    return placed.select(scope, "name", "level", (F.col("_rank") + F.col("_shift")).alias("place"))

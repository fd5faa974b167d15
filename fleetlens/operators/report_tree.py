"""The status report as a directory tree, held as rows.

A directory whose entries all have the same value takes that value: a text when they are
runs in one state, else the entries they share. The nested report is kept as one row per
visible entry rather than one document, so it can be as large as the fleet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logs import run_number
from ..functions.paths import base_name, parent_path
from ..session import pin
from .ordered import rank_within


def _depth(path):
    return F.size(F.split(path, "/"))


def _roots(root: str | list[str]) -> list[str]:
    """Roots without their last slash; of several with one name the last is reported."""
    given = [r.rstrip("/") or "/" for r in ([root] if isinstance(root, str) else root)]
    return list({r.rpartition("/")[2]: r for r in given}.values())


def _below(roots: list[str]) -> Column:
    """Places of ``run_path`` below the roots that hold it: the root's number, then the rest of the path."""
    places = []
    for number, root in enumerate(roots):
        start = "" if root == "/" else root
        inside = (F.col("run_path") == root) | F.startswith("run_path", F.lit(f"{start}/"))
        places.append(F.when(inside, F.concat(F.lit(f"/{number}"), F.substr("run_path", F.lit(len(start) + 1)))))
    return F.array_compact(F.array(*places))


def _records(details: DataFrame) -> DataFrame:
    """Two hashes of all rows that ``details(run_path, ...)`` has for a run, whatever their order."""
    rest = sorted(c for c in details.columns if c != "run_path")
    row = lambda seed: F.sum(F.xxhash64(F.lit(seed), *rest).cast("decimal(38,0)")).cast("string")
    return details.groupBy("run_path").agg(row("d").alias("_d1"), row("e").alias("_d2"))


def rollup_tree(status: DataFrame, root: str | list[str], collapse_top: bool = True, details: DataFrame | None = None) -> DataFrame:
    """Visible entries ``(path, parent, name, level, position, text, run_path)`` of the report over one root or several.

    ``text`` is the status text of a run or of a directory in one state and null for a directory
    with entries below it. ``path`` is the place in the report. ``position`` is the place among the entries of a
    directory: by progress, status, run number and name where all have a text, else by name. ``run_path`` is a run that
    an entry with a text stands for. With ``details(run_path, ...)``, as from ``group_issues``, only entries that agree in all
    rows of details, too, are folded, and the rows of ``run_path`` are those of each run folded into it.

    The loops run once per directory level and read each level once; only the tree depth (one number) comes to the
    driver. ``collapse_top=False`` keeps the entries of the roots themselves apart. Of roots with one name the last counts.
    """
    roots, top = _roots(root), 2
    value = [F.col("status_text")]
    if details is not None:
        status, value = status.join(_records(details), "run_path", "left"), [*value, F.col("_d1"), F.col("_d2")]
    leaves = status.withColumn("path", F.explode(_below(roots)))
    leaves = pin(
        leaves.select(
            "path",
            parent_path("path").alias("parent"),
            base_name("path").alias("name"),
            F.col("status_text").alias("text"),
            F.xxhash64(F.lit("t"), *value).alias("h1"),
            F.xxhash64(F.lit("u"), *value).alias("h2"),
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("boolean").alias("mixed"),
            "run_path",
            F.col("progress"),
            F.col("severity"),
            _depth(F.col("path")).alias("depth"),
        )
    )
    deepest = leaves.agg(F.max("depth")).first()[0] or top

    levels = {deepest: leaves.where(F.col("depth") == deepest)}
    for depth in range(deepest - 1, top - 1, -1):
        folded = _fold(levels[depth + 1], keep_apart=(depth == top and not collapse_top))
        merged = folded.withColumn("depth", F.lit(depth)).unionByName(leaves.where(F.col("depth") == depth))
        levels[depth] = pin(merged)

    # a directory's entries lie one level below its source, so each level is joined once, to the sources just above it
    root_name = F.array(*(F.lit(r) for r in roots))
    number = F.substr("path", F.lit(2)).cast("int")
    shown = levels[top].select(
        *_NODE,
        F.get(root_name, number).alias("shown"),
        F.lit(None).cast("string").alias("shown_parent"),
        F.lit(0).alias("level"),
        _shared_mix(levels[top]),
    ).withColumn("name", base_name("shown"))
    result, waiting = _entries(shown), [_open(shown)]
    for depth in range(top, deepest):
        above = None
        for opened in waiting:
            here = opened.where(F.col("source_depth") == depth).drop("source_depth")
            above = here if above is None else above.unionByName(here)
        above = above.withColumnRenamed("source", "parent")
        place = F.concat(F.when(F.col("shown_parent") != "/", F.col("shown_parent")).otherwise(""), F.lit("/"), "name")
        below = levels[depth + 1].join(above, "parent").select(*_NODE, place.alias("shown"), "shown_parent", "level", "among_mixed")
        below = pin(below)
        result = result.unionByName(_entries(below))
        waiting.append(_open(below))
    rated = lambda value: F.when(~F.col("_among_mixed"), value)
    order = [
        rated(F.col("_progress")).desc(), rated(F.col("_severity")).asc(), rated(run_number("name")).asc(), F.col("name").asc(), F.col("path").asc(),
    ]
    placed = rank_within(result, ["parent"], order, "position")
    return placed.select("path", "parent", "name", "level", "position", "text", "run_path")


_NODE = ["path", "name", "text", "source", "mixed", "run_path", "progress", "severity"]


def _shared_mix(tops: DataFrame) -> Column:
    """Whether any of the topmost entries is a directory; there are no more of them than roots."""
    return F.lit(bool(tops.where("text is null").limit(1).count())).alias("among_mixed")


def _open(shown: DataFrame) -> DataFrame:
    """Directories that show entries: their place, and where in the tree the entries are."""
    return shown.where("text is null").select(
        "source",
        F.col("shown").alias("shown_parent"),
        (F.col("level") + 1).alias("level"),
        F.col("mixed").alias("among_mixed"),
        _depth(F.col("source")).alias("source_depth"),
    )


def _fold(children: DataFrame, keep_apart: bool = False) -> DataFrame:
    """Directories of one level from their entries, by one aggregation per directory."""
    entry = lambda seed, h: F.xxhash64(F.lit(seed), F.col("name"), F.col(h))
    folded = children.groupBy(F.col("parent").alias("path")).agg(
        ((F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2"))).alias("same"),
        F.min("text").alias("text"),
        F.min("h1").alias("c1"),
        F.min("h2").alias("c2"),
        F.bit_xor(entry("d", "h1")).alias("d1"),
        F.bit_xor(entry("e", "h2")).alias("d2"),
        F.min_by(F.struct("source", "mixed", "run_path"), "name").alias("first"),
        F.bool_or(F.col("text").isNull()).alias("has_open"),
        F.max("progress").alias("progress"),
        F.max("severity").alias("severity"),
    )
    same = F.lit(False) if keep_apart else F.col("same")
    return folded.select(
        "path",
        parent_path("path").alias("parent"),
        base_name("path").alias("name"),
        F.when(same, F.col("text")).alias("text"),
        F.when(same, F.col("c1")).otherwise(F.col("d1")).alias("h1"),
        F.when(same, F.col("c2")).otherwise(F.col("d2")).alias("h2"),
        F.when(~same, F.col("path")).otherwise(F.col("first.source")).alias("source"),
        F.when(~same, F.col("has_open")).otherwise(F.col("first.mixed")).alias("mixed"),
        F.when(same, F.col("first.run_path")).alias("run_path"),
        "progress",
        "severity",
    )


def _entries(shown: DataFrame) -> DataFrame:
    return shown.select(
        F.col("shown").alias("path"),
        F.col("shown_parent").alias("parent"),
        "name",
        "level",
        "text",
        F.when(F.col("text").isNotNull(), F.col("run_path")).alias("run_path"),
        F.col("progress").alias("_progress"),
        F.col("severity").alias("_severity"),
        F.col("among_mixed").alias("_among_mixed"),
    )

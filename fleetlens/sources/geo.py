"""Mesh, nodal attribute and storm track files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import parse_datetime
from ..functions.paths import plain_path
from .boundaries import read_boundaries
from .text import _placed_lines, number_lines


def _numbered(spark: SparkSession, paths: list[str] | str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return number_lines(_placed_lines(reader, paths)).withColumnRenamed("path", "mesh_id")


def _split(lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.split(F.trim("line"), r"\s+"))


def _int(i: int) -> Column:
    return F.get("w", i).try_cast("bigint")


def _double(i: int) -> Column:
    return F.get("w", i).try_cast("double")


class MeshTables:
    """The three tables of a set of meshes. Boundaries take jobs of their own, which run when they are first asked for."""

    def __init__(self, nodes: DataFrame, elements: DataFrame, tail: DataFrame):
        self.nodes = nodes
        self.elements = elements
        self._tail = tail

    @cached_property
    def boundaries(self) -> DataFrame:
        return read_boundaries(self._tail)


def scan_mesh(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> MeshTables:
    """Nodes, elements and boundary nodes of ``fort.14`` or ``gr3`` files; a mesh is named by its path."""
    return parse_mesh(_numbered(spark, paths, glob))


def parse_mesh(lines: DataFrame) -> MeshTables:
    """The tables of meshes given as ``(mesh_id, line_no, line)``, lines counted from 1.

    The header gives the number of elements and nodes, so each line's place tells what it is. The
    blocks of the boundary tail each start with a count, which tells where the next one starts.
    """
    lines = _split(lines)
    header = lines.where("line_no = 2").select("mesh_id", _int(0).alias("n_elements"), _int(1).alias("n_nodes"))
    placed = lines.join(header, "mesh_id")
    last_node = F.col("n_nodes") + 2
    last_element = last_node + F.col("n_elements")
    nodes = placed.where((F.col("line_no") > 2) & (F.col("line_no") <= last_node)).select(
        "mesh_id", _int(0).alias("node_id"), _double(1).alias("x"), _double(2).alias("y"), _double(3).alias("z")
    )
    elements = placed.where((F.col("line_no") > last_node) & (F.col("line_no") <= last_element)).select(
        "mesh_id",
        _int(0).alias("element_id"),
        F.transform(F.slice("w", 3, F.get("w", 1).cast("int")), lambda n: n.try_cast("bigint")).alias("nodes"),
    )
    tail = placed.where(F.col("line_no") > last_element).select("mesh_id", "line_no", "w")
    return MeshTables(nodes, elements, tail)


class AttributeTables:
    """Defaults and exceptions of nodal attributes."""

    def __init__(self, defaults: DataFrame, exceptions: DataFrame):
        self.defaults = defaults
        self.exceptions = exceptions


def scan_nodal_attributes(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> AttributeTables:
    """Attribute defaults and per-node exceptions of ``fort.13`` files, each with the array of its ``values``."""
    return parse_nodal_attributes(_numbered(spark, paths, glob))


def parse_nodal_attributes(lines: DataFrame) -> AttributeTables:
    """Defaults and exceptions of attribute files given as ``(mesh_id, line_no, line)``, lines counted from 1.

    The header names every attribute on four lines; after it a line with an attribute's name starts
    its exceptions. The starts of a file are as few as its attributes, so each data line finds its
    section in an array.
    """
    lines = _split(lines)
    counts = lines.where("line_no = 3").select("mesh_id", _int(0).alias("n_attributes"))
    placed = lines.join(counts, "mesh_id")
    in_header = (F.col("line_no") > 3) & (F.col("line_no") <= 3 + 4 * F.col("n_attributes"))
    header = placed.where(in_header)
    slot = F.floor((F.col("line_no") - 4) / 4)
    field = F.pmod(F.col("line_no") - 4, F.lit(4))
    text = F.trim("line")
    numbers = F.transform("w", lambda word: word.try_cast("double"))
    defaults = (
        header.groupBy("mesh_id", slot.alias("slot"))
        .agg(
            F.max(F.when(field == 0, text)).alias("attribute"),
            F.max(F.when(field == 1, text)).alias("units"),
            F.max(F.when(field == 2, text)).try_cast("int").alias("n_values"),
            F.max(F.when(field == 3, numbers)).alias("values"),
        )
        .drop("slot")
    )
    data = placed.where(F.col("line_no") > 3 + 4 * F.col("n_attributes"))
    is_name = _double(0).isNull() & (text != "")
    starts = (
        data.where(is_name)
        .groupBy("mesh_id")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("attribute")))).alias("starts"))
    )
    section = F.element_at(F.filter("starts", lambda s: s.line_no < F.col("line_no")), -1)
    exceptions = (
        data.where(~is_name & (text != ""))
        .join(starts, "mesh_id")
        .withColumn("section", section)
        .where(F.col("line_no") > F.col("section.line_no") + 1)
        .select("mesh_id", F.col("section.attribute").alias("attribute"), _int(0).alias("node_id"), F.slice(numbers, 2, F.size("w")).alias("values"))
    )
    return AttributeTables(defaults, exceptions)


def scan_best_track(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> DataFrame:
    """ATCF rows as a typed track; the storm is named by its file."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(paths).select(plain_path(F.col("_metadata.file_path")).alias("storm_id"), "value")
    return parse_best_track(rows)


def parse_best_track(rows: DataFrame) -> DataFrame:
    """Typed track of ``(storm_id, value)`` rows in ATCF layout."""
    part = lambda i: F.trim(F.get("p", i))
    text = lambda i: F.when(part(i) != "", part(i))
    whole = lambda i: part(i).try_cast("int")

    def degrees(i: int, negative: str) -> Column:
        tenths = F.regexp_extract(part(i), r"^(\d+)", 1).try_cast("double") / 10
        return F.when(F.endswith(part(i), F.lit(negative)), -tenths).otherwise(tenths)

    return (
        rows.where(F.trim("value") != "")
        .withColumn("p", F.split("value", ","))
        .select(
            "storm_id",
            text(0).alias("basin"),
            text(1).alias("storm_number"),
            parse_datetime(part(2)).alias("ts"),
            text(4).alias("record_type"),
            whole(5).alias("forecast_hours"),
            degrees(6, "S").alias("lat"),
            degrees(7, "W").alias("lon"),
            whole(8).alias("max_wind"),
            whole(9).alias("pressure"),
            text(10).alias("level"),
            whole(11).alias("isotach"),
            text(12).alias("quadrant"),
            whole(13).alias("radius_ne"),
            whole(14).alias("radius_se"),
            whole(15).alias("radius_sw"),
            whole(16).alias("radius_nw"),
            whole(17).alias("outer_pressure"),
            whole(18).alias("outer_radius"),
            whole(19).alias("max_wind_radius"),
            whole(20).alias("gusts"),
            whole(21).alias("eye"),
            text(22).alias("subregion"),
            whole(25).alias("direction"),
            whole(26).alias("speed"),
            text(27).alias("name"),
            whole(28).alias("record"),
        )
    )

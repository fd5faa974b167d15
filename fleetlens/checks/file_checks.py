"""Checks of file layouts made from the tables, and of what writers leave for readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.config import parse_documents
from ..operators.ordered import rank_within
from ..session import ensure_checkpoint_dir, pin
from ..sources.geo import parse_mesh, parse_nodal_attributes
from ..sources.run_files import scan_forcing_files, scan_run_files
from ..sources.run_tree import plain_root
from ..sources.sinks import write_config_docs, write_job_manifest, write_status_report
from ..sources.text import listed_log_lines, scan_config_docs
from .registry import check, table

# Each brand is a mesh with its parts as nodes and one element per node. Parts are in one of three boundaries.
_PARTS = """parts AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, side ORDER BY node_id)::INTEGER AS pos,
                             row_number() OVER (PARTITION BY mesh_id ORDER BY node_id) AS place
  FROM (SELECT p_brand AS mesh_id, p_partkey AS node_id, p_size AS size, CASE WHEN p_partkey % 2 = 0 THEN 'open' WHEN p_partkey % 3 = 0 THEN 'land' ELSE 'isle' END AS side FROM part))"""


def _text(*parts) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts with their places in the mesh and in their boundary, and the counts of each mesh."""
    key = F.col("p_partkey")
    side = F.when(key % 2 == 0, "open").when(key % 3 == 0, "land").otherwise("isle")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("mesh_id"), key.alias("node_id"), F.col("p_size").alias("size"), side.alias("side")
    )
    parts = rank_within(rank_within(parts, ["mesh_id"], [F.col("node_id")], "place"), ["mesh_id", "side"], [F.col("node_id")], "pos")
    counts = parts.groupBy("mesh_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("open", "land", "isle")]
    )
    return pin(parts.join(counts, "mesh_id")), counts


def _lines(rows: DataFrame, *lines: tuple[Column, Column]) -> DataFrame:
    """A line per row and pair of line number and text; pairs without number are left out."""
    pairs = [F.when(no.isNotNull(), F.struct(no.cast("bigint").alias("line_no"), text.alias("line"))) for no, text in lines]
    return rows.select("mesh_id", F.inline(F.array_compact(F.array(*pairs))))


def _mesh_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, counts = _parts(spark, sf_dir)
    n, opened, land = F.col("n"), F.col("n_open"), F.col("n_land")
    tail = 2 * n + 2
    coast = tail + 3 + opened
    head = _lines(
        counts,
        (F.lit(1), F.col("mesh_id")),
        (F.lit(2), _text(n, n)),
        (tail + 1, F.lit("1 = open boundaries")), (tail + 2, _text(opened, "= nodes")), (tail + 3, _text(opened)),
        (coast + 1, F.lit("2 = land boundaries")), (coast + 2, _text(n - opened, "= nodes")), (coast + 3, _text(land, "20")),
        (coast + 4 + land, _text(F.col("n_isle"), "21")),
    )
    before = F.when(F.col("side") == "open", tail + 3).when(F.col("side") == "land", coast + 3).otherwise(coast + 4 + land)
    node, size, place = F.col("node_id"), F.col("size"), F.col("place")
    body = _lines(
        parts,
        (place + 2, _text(node, size, size * 2, "-7.5")),
        (place + 2 + n, _text(place, "3", node, node + 1, node + 2)),
        (before + F.col("pos"), _text("", node)),
    )
    return head.unionByName(body)


@check(f"WITH {_PARTS} SELECT mesh_id, node_id, size::DOUBLE AS x, 2.0 * size::DOUBLE AS y, -7.5::DOUBLE AS z FROM parts")
def parsed_mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_mesh(_mesh_lines(spark, sf_dir)).nodes


@check(
    f"WITH {_PARTS} SELECT mesh_id, place AS element_id, concat_ws(',', node_id, node_id + 1, node_id + 2) AS nodes FROM parts"
)
def parsed_mesh_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = parse_mesh(_mesh_lines(spark, sf_dir)).elements
    return elements.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@check(
    f"""WITH {_PARTS} SELECT mesh_id, side = 'open' AS is_open, CASE side WHEN 'isle' THEN 2 ELSE 1 END AS boundary_id,
       CASE side WHEN 'land' THEN 20 WHEN 'isle' THEN 21 END AS boundary_type, pos, node_id FROM parts"""
)
def parsed_mesh_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_mesh(_mesh_lines(spark, sf_dir)).boundaries


def _attribute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes, one of three values; open nodes differ in the first and land nodes in the second."""
    parts, counts = _parts(spark, sf_dir)
    opened = F.col("n_open")
    words = [F.col("mesh_id"), _text(F.col("n")), "2", "tau0", "1", "1", "0.03", "slope", "unitless", "3", "0.1 0.2 0.3", "tau0", _text(opened)]
    head = _lines(
        counts,
        *((F.lit(i + 1), F.lit(w) if isinstance(w, str) else w) for i, w in enumerate(words)),
        (opened + 14, F.lit("slope")), (opened + 15, _text(F.col("n_land"))),
    )
    side, pos = F.col("side"), F.col("pos")
    body = _lines(
        parts,
        (F.when(side == "open", pos + 13), _text(F.col("node_id"), F.col("size"))),
        (F.when(side == "land", pos + 15 + opened), _text(F.col("node_id"), F.col("size"), "-1.5", F.col("place"))),
    )
    return head.unionByName(body)


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "values"], *[F.get("values", F.lit(i)).alias(f"v{i}") for i in range(3)])


@check(
    """SELECT DISTINCT p_brand AS mesh_id, v.* FROM part, (VALUES ('tau0', '1', 1, 0.03::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
       ('slope', 'unitless', 3, 0.1, 0.2, 0.3)) v(attribute, units, n_values, v0, v1, v2)"""
)
def parsed_attribute_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(parse_nodal_attributes(_attribute_lines(spark, sf_dir)).defaults)


@check(
    f"""WITH {_PARTS} SELECT mesh_id, CASE side WHEN 'open' THEN 'tau0' ELSE 'slope' END AS attribute, node_id, size::DOUBLE AS v0,
       CASE side WHEN 'land' THEN -1.5::DOUBLE END AS v1, CASE side WHEN 'land' THEN place::DOUBLE END AS v2 FROM parts WHERE side <> 'isle'"""
)
def parsed_attribute_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(parse_nodal_attributes(_attribute_lines(spark, sf_dir)).exceptions)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/check-{uuid.uuid4().hex}"


@check(
    """SELECT s_suppkey, 'slurm' AS kind, 'configure_slurm.json' AS file_name, '"' || s_name || '"' AS account, CAST(s_nationkey * 60 AS VARCHAR) AS duration FROM supplier"""
)
def documents_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per supplier; the second writing finds them all and leaves them."""
    folder = _folder(spark)
    raw = F.to_json(F.struct(F.col("s_name").alias("account"), (F.col("s_nationkey") * 60).alias("job_duration")))
    documents = parse_documents(
        table(spark, sf_dir, "supplier").select(
            F.concat(F.lit(f"{folder}/"), "s_suppkey").alias("config_dir"), F.lit("slurm").alias("kind"), F.lit("").alias("file_name"), raw.alias("raw")
        )
    )
    written, again = write_config_docs(documents), write_config_docs(documents)
    if again or not written:
        raise ValueError(f"{written} documents written, then {again}")
    read = parse_documents(scan_config_docs(spark, [folder]))
    key = F.substring_index("config_dir", "/", -1).cast("bigint").alias("s_suppkey")
    return read.select(key, "kind", "file_name", F.col("fields")["account"].alias("account"), F.col("fields")["job_duration"].alias("duration"))


@check("SELECT o_orderkey AS run, o_orderstatus AS status, nullif(o_custkey % 7, 0)::BIGINT AS progress FROM orders")
def report_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls come back as nulls."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.nullif(F.col("o_custkey") % 7, F.lit(0)).cast("bigint").alias("progress")
    )
    folder = _folder(spark)
    write_status_report(rows, folder)
    return spark.read.schema("run bigint, status string, progress bigint").json(folder)


@check(
    """SELECT CASE WHEN o_custkey % 5 = 0 THEN -o_orderkey WHEN o_custkey % 3 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS job,
              '/configs/' || o_custkey AS config_dir FROM orders"""
)
def manifest_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First every configuration but each third; then all, which adds these alone; then each fifth anew, which replaces them."""
    config = F.concat(F.lit("/configs/"), "o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), config.alias("config_dir"), "o_custkey")
    folder = _folder(spark)
    later = rows.withColumn("job", F.col("job") + 1_000_000_000)
    write_job_manifest(rows.where("o_custkey % 3 <> 0"), folder)
    write_job_manifest(later, folder)
    write_job_manifest(rows.where("o_custkey % 5 = 0").withColumn("job", -F.col("job")), folder, overwrite=True)
    return spark.read.schema("job bigint, config_dir string").parquet(folder).select("job", "config_dir")


def _write_tree(batches):
    """A file of each row's path and text; an empty text makes an empty file, a null one a directory."""
    import os

    import pyarrow as pa

    for batch in batches:
        for path, text in zip(*(c.to_pylist() for c in batch.columns)):
            os.makedirs(path if text is None else os.path.dirname(path), exist_ok=True)
            if text is not None:
                with open(path, "w") as out:
                    out.write(text)
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})


def _tree(spark: SparkSession, files: DataFrame) -> str:
    """A folder with the files of ``files(rel_path, text)``."""
    folder = plain_root(_folder(spark))
    files.select(F.concat(F.lit(f"{folder}/"), "rel_path"), "text").mapInArrow(_write_tree, "n bigint").agg(F.sum("n")).collect()
    return folder


def _run_tree(spark: SparkSession, sf_dir: str) -> str:
    """A run directory per supplier below its nation, with a log of one to four lines, an empty file and an empty directory."""
    run = F.concat_ws("/", "s_nationkey", F.concat(F.lit("run_"), "s_suppkey"))
    lines = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("s_suppkey") % 4), lambda i: F.concat(i, F.lit("% COMPLETE "), "s_name"))
    contents = {
        "ADCIRC_RUN_x.out.log": F.array_join(lines, "\n"),
        "outputs/mirror.out": F.repeat(F.lit("x"), (F.col("s_suppkey") % 50).cast("int")),
        "fort.14": F.lit(""),
        "empty": F.lit(None).cast("string"),
        "wind_1.nc": F.col("s_name"),
    }
    files = F.array(*(F.struct(F.lit(name).alias("name"), text.alias("text")) for name, text in contents.items()))
    rows = table(spark, sf_dir, "supplier").select(run.alias("run"), F.explode(files).alias("f"))
    return _tree(spark, rows.select(F.concat_ws("/", "run", "f.name").alias("rel_path"), F.col("f.text").alias("text")))


@check(
    """WITH runs AS (SELECT s_nationkey, s_suppkey, '/' || s_nationkey || '/run_' || s_suppkey AS run, s_name FROM supplier)
       SELECT run AS run_path, v.rel_path, v.is_dir, v.length::BIGINT AS length FROM runs, (VALUES
              ('outputs/mirror.out', false, s_suppkey % 50), ('fort.14', false, 0), ('empty', true, 0), ('outputs', true, 0), ('wind_1.nc', false, length(s_name)),
              ('ADCIRC_RUN_x.out.log', false, (13 + length(s_name)) * (s_suppkey % 4 + 1) - 1))
            v(rel_path, is_dir, length)
       UNION ALL SELECT DISTINCT '', s_nationkey::VARCHAR, true, 0 FROM supplier
       UNION ALL SELECT '/' || s_nationkey, 'run_' || s_suppkey, true, 0 FROM supplier"""
)
def tree_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a tree, empty files and directories too."""
    folder = _run_tree(spark, sf_dir)
    listed = scan_run_files(spark, [folder])
    return listed.select(F.substr("run_path", F.lit(len(folder) + 1)).alias("run_path"), "rel_path", "is_dir", "length")


@check(
    """SELECT s_nationkey || '/run_' || s_suppkey AS run, i || '% COMPLETE ' || s_name AS line, (i + 1)::INTEGER AS place
       FROM supplier, range(4) t(i) WHERE i <= s_suppkey % 4"""
)
def log_lines_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of listed logs, read in ranges of 16 bytes; the places of their first bytes put them in order."""
    folder = _run_tree(spark, sf_dir)
    lines = listed_log_lines(scan_run_files(spark, [folder]), "ADCIRC_*.out.log", span=16)
    place = F.row_number().over(Window.partitionBy("run_path").orderBy("line_no"))
    return lines.select(F.substr("run_path", F.lit(len(folder) + 2)).alias("run"), "line", place.alias("place"))


@check("SELECT 1::INTEGER AS stream, s_nationkey || '/run_' || s_suppkey || '/wind_1.nc' AS path, length(s_name)::BIGINT AS length FROM supplier")
def forcing_files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_tree(spark, sf_dir)
    found = scan_forcing_files(spark, folder, "*/*/*_1.nc", "*/*/*_2.nc")
    return found.select("stream", F.substr("path", F.lit(len(folder) + 2)).alias("path"), "length")

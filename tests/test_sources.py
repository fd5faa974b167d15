import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.config import config_fields, parse_documents, same_document, typed_fields
from fleetlens.operators.diff import diff_sizes, diff_trees
from fleetlens.operators.mesh import dense_attributes, same_mesh
from fleetlens.operators.planning import job_manifest
from fleetlens.operators.track import clip_track, storm_ids
from fleetlens.sources import run_tree
from fleetlens.sources.geo import scan_best_track, scan_mesh, scan_nodal_attributes
from fleetlens.sources.ranges import cut_ranges, lines_between, listed_path, read_lines, read_texts
from fleetlens.sources.run_files import scan_forcing_files, scan_run_files
from fleetlens.sources.sinks import MANIFEST_PARTS, write_config_docs, write_job_manifest
from fleetlens.sources.text import latest_jobs, listed_log_lines, parse_job_queue, scan_config_docs, scan_job_queue, scan_log_lines, scan_tree_lines

MESH = """made up
2 4
1 -72.5 40.5 1.0
2 -7.25E+01 4.1E+01 2.5
3 -72.0 40.5 -1.25
4 -72.0 41.0 3.0
1 3 1 2 3
2 3 2 3 4
1 ! open boundaries
2 ! open nodes
2 ! first
4
3
2 = land boundaries
3 = land nodes
2 0 = first
1
2
1 20 = second
4
"""
ATTRIBUTES = """made up
4
2
tau0
unitless
1
0.03
slope
s/m
3
0.02 1.5 -2.0
tau0
2
1 0.5
3 0.25
slope
1
4 0.125 7.0 0.0
"""
TRACK = """EP, 14, 2031070300,   , BEST,   0, 113N, 1057W,  25, 1007, TD,   0,    ,    0,    0,    0,    0, 1012,  180,  60,     ,    ,    ,    ,    ,290,   9,   SEEDLING,   ,   1
EP, 14, 2031070318,   , BEST,  18, 121S, 1093E,  55,  991, TS,  34, SWQ,   40,   65,   20,   35, 1012,  180,  45,     ,    ,    ,    ,    ,301,  11,   MADEUP    ,   2
"""


def test_listing_sees_empty_files_and_directories(spark, tmp_path):
    (tmp_path / "a" / "outputs").mkdir(parents=True)
    (tmp_path / "a" / "empty").write_text("")
    (tmp_path / "a" / "outputs" / "mirror.out").write_text("12345")
    (tmp_path / "b").mkdir()
    os.symlink(tmp_path, tmp_path / "b" / "loop")
    root = str(tmp_path)
    rows = {(r.run_path[len(root):], r.rel_path, r.is_dir, r.length) for r in scan_run_files(spark, [root + "/", root + "/none"]).collect()}
    assert rows == {
        ("", "a", True, 0), ("", "b", True, 0), ("/a", "outputs", True, 0), ("/a", "empty", False, 0),
        ("/a", "outputs/mirror.out", False, 5),
    }


def names(spark, root):
    return {(r.run_path[len(str(root)):], r.rel_path) for r in scan_run_files(spark, [str(root)]).collect()}


def test_links_to_siblings_are_followed_and_circles_are_not(spark, tmp_path):
    for name in ("run_1", "run_10", "crossed_a", "crossed_b"):
        (tmp_path / name).mkdir()
    (tmp_path / "run_1" / "x").write_text("x")
    os.symlink(tmp_path / "run_1", tmp_path / "run_10" / "to_1")
    os.symlink(tmp_path / "crossed_b", tmp_path / "crossed_a" / "b")
    os.symlink(tmp_path / "crossed_a", tmp_path / "crossed_b" / "a")
    assert {n for n in names(spark, tmp_path) if n[0]} == {("/run_1", "x"), ("/run_10", "to_1"), ("/run_10/to_1", "x"), ("/crossed_a", "b"), ("/crossed_b", "a")}


def test_unreadable_directory_is_a_row(monkeypatch):
    def entries(directory):
        if directory == "/locked":
            raise PermissionError("no")
        yield "f", False, 1

    monkeypatch.setattr(run_tree, "local_entries", entries)
    shards = run_tree.plan_shards(["/locked", "/open"], 2)
    rows = [row[1:] for shard in shards for row in run_tree.walk(shard)]
    assert sorted(rows, key=str) == [("/locked", None, False, 0, "no"), ("/open", "f", False, 1, None)]


def test_shards_cover_a_tree_once(tmp_path, monkeypatch):
    monkeypatch.setattr(run_tree, "WIDE", 7)
    for i in range(40):
        (tmp_path / "wide" / f"d{i}" / "x").mkdir(parents=True)
        (tmp_path / "wide" / f"f{i}").write_text("1")
    (tmp_path / "a" / "b" / "c" / "d").mkdir(parents=True)
    wanted = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))
    for count in (1, 2, 5, 30, 500):
        shards = run_tree.plan_shards([str(tmp_path)], count)
        found = [os.path.relpath(f"{directory}/{name}", tmp_path) for shard in shards for _, directory, name, *_ in run_tree.walk(shard)]
        assert sorted(found) == wanted and len(shards) <= count
    # a directory with many directories is opened by several tasks, and its names are not held
    assert [len(s.wide) for s in run_tree.plan_shards([str(tmp_path)], 30)] == [1] * 6


def test_forcing_streams(spark, tmp_path):
    for name in ("wind_1.nc", "wind_2.nc", "notes"):
        (tmp_path / name).write_text("x")
    rows = [(r.stream, r.path.split("/")[-1]) for r in scan_forcing_files(spark, str(tmp_path)).orderBy("stream").collect()]
    assert rows == [(1, "wind_1.nc"), (2, "wind_2.nc")]


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


def test_line_order_over_many_splits(spark, tmp_path, small_splits):
    for run, count in (("a", 9000), ("b", 50), ("c", 3000)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "ADCIRC_X_y.out.log").write_text("".join(f"line {i}\n" for i in range(count)))
    listed = scan_run_files(spark, [str(tmp_path)])
    assert cut_ranges(listed.select(listed_path().alias("path"), "length"), 8192).count() > 8
    for lines in (listed_log_lines(listed, span=8192), scan_log_lines(spark, [str(tmp_path)])):
        for run, count in (("a", 9000), ("b", 50), ("c", 3000)):
            got = [r.line for r in lines.where(F.col("run_path").endswith("/" + run)).orderBy("line_no").collect()]
            assert got == [f"line {i}" for i in range(count)]
    numbered = scan_tree_lines(spark, str(tmp_path))
    wrong = numbered.where(F.concat(F.lit("line "), F.col("line_no") - 1) != F.col("line"))
    assert numbered.count() == 12050 and wrong.isEmpty()


def test_mesh(spark, tmp_path):
    (tmp_path / "fort.14").write_text(MESH)
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "fort.14").write_text(MESH.replace("+01 2.5", "+01 2.75"))
    mesh = scan_mesh(spark, str(tmp_path), "fort.14")
    first = F.col("mesh_id") == str(tmp_path / "fort.14")
    assert [tuple(r)[1:] for r in mesh.nodes.where(first).orderBy("node_id").collect()] == [
        (1, -72.5, 40.5, 1.0), (2, -72.5, 41.0, 2.5), (3, -72.0, 40.5, -1.25), (4, -72.0, 41.0, 3.0)]
    assert [(r.element_id, r.nodes) for r in mesh.elements.where(first).orderBy("element_id").collect()] == [(1, [1, 2, 3]), (2, [2, 3, 4])]
    boundary = mesh.boundaries.where(first).orderBy(F.col("is_open").desc(), "boundary_id", "pos").collect()
    assert [tuple(r)[1:] for r in boundary] == [
        (True, 1, None, 1, 4), (True, 1, None, 2, 3), (False, 1, 0, 1, 1), (False, 1, 0, 2, 2), (False, 2, 20, 1, 4)]
    a, b = mesh.nodes.where(first), mesh.nodes.where(~first)
    same = same_mesh(a.withColumn("mesh_id", F.lit("m")), b.withColumn("mesh_id", F.lit("m")), ["node_id"], ["x", "y", "z"])
    assert [(r.mismatches, r.is_same) for r in same.collect()] == [(1, False)]


def test_nodal_attributes(spark, tmp_path):
    (tmp_path / "fort.13").write_text(ATTRIBUTES)
    (tmp_path / "fort.14").write_text(MESH)
    tables = scan_nodal_attributes(spark, str(tmp_path), "fort.13")
    assert {(r.attribute, r.units, r.n_values, *r["values"]) for r in tables.defaults.collect()} == {
        ("tau0", "unitless", 1, 0.03), ("slope", "s/m", 3, 0.02, 1.5, -2.0)}
    assert {(r.attribute, r.node_id, *r["values"]) for r in tables.exceptions.collect()} == {
        ("tau0", 1, 0.5), ("tau0", 3, 0.25), ("slope", 4, 0.125, 7.0, 0.0)}
    renamed = lambda df: df.withColumn("mesh_id", F.lit("m"))
    dense = dense_attributes(renamed(scan_mesh(spark, str(tmp_path), "fort.14").nodes), renamed(tables.defaults), renamed(tables.exceptions))
    assert [r["values"] for r in dense.where("attribute = 'tau0'").orderBy("node_id").collect()] == [[0.5], [0.03], [0.25], [0.03]]
    assert dense.where("attribute = 'slope' and node_id = 4").first()["values"] == [0.125, 7.0, 0.0]


def test_best_track(spark, tmp_path):
    (tmp_path / "fort.22").write_text(TRACK)
    track = scan_best_track(spark, str(tmp_path))
    rows = track.orderBy("ts").collect()
    assert [(r.lat, r.lon, r.max_wind, r.name, r.quadrant, r.radius_sw) for r in rows] == [
        (11.3, -105.7, 25, "SEEDLING", None, 0), (-12.1, 109.3, 55, "MADEUP", "SWQ", 20)]
    assert [r.storm_code for r in storm_ids(track).collect()] == ["EP142031"]
    storm = rows[0].storm_id
    windows = spark.createDataFrame(
        [("open", storm, None, None), ("late", storm, "2031-07-03 18:00:00", None), ("none", storm, "2032-01-01", None)],
        "config_dir string, storm_id string, s string, e string",
    ).select("config_dir", "storm_id", F.col("s").cast("timestamp_ntz").alias("start_ts"), F.col("e").cast("timestamp_ntz").alias("end_ts"))
    counts = {r.config_dir: r["count"] for r in clip_track(track, windows).groupBy("config_dir").count().collect()}
    assert counts == {"open": 2, "late": 1}


def test_queue_snapshot(spark, tmp_path):
    path = tmp_path / "queue"
    path.write_text("NAME WORK_DIR JOBID\n a  /x 1\nb /y 2\na /z 3\n\n")
    queue = scan_job_queue(spark, str(path))
    plain = lambda rows: sorted(tuple(r)[:3] for r in rows.select("job_name", "workdir", "job_id").collect())
    assert plain(queue) == [("a", "/x", "1"), ("a", "/z", "3"), ("b", "/y", "2")]
    assert plain(latest_jobs(queue)) == [("a", "/z", "3"), ("b", "/y", "2")]


def test_documents_round_trip(spark, tmp_path):
    document = {"Account": "coastal", "job_duration": 21600.0, "modules": [], "nodes": None, "extra": {"k": "v"}, "note": "2"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "configure_slurm.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "in" / "configure_nems.json").write_text('{"interval": ')
    parsed = parse_documents(scan_config_docs(spark, str(tmp_path / "in")))
    assert {(r.kind, r.is_corrupt, r.file_name) for r in parsed.collect()} == {
        ("slurm", False, "configure_slurm.json"), ("nems", True, "configure_nems.json")}
    good = parsed.where("not is_corrupt")
    wide = typed_fields(good, "slurm").first()
    assert (wide.account, wide.job_duration, wide.modules, wide.nodes) == ("coastal", 21600.0, [], None)
    assert wide.extra == {"extra": '{"k":"v"}', "note": "2"}
    assert [r.field for r in config_fields(good).orderBy("pos").collect()] == [k.lower() for k in document]

    moved = good.withColumn("config_dir", F.lit(str(tmp_path / "out" / "deep")))
    assert write_config_docs(moved) == 1
    target = tmp_path / "out" / "deep" / "configure_slurm.json"
    assert json.loads(target.read_text()) == {k.lower(): v for k, v in document.items()}
    target.write_text('{"account": "kept"}')
    assert write_config_docs(moved) == 0 and "kept" in target.read_text()
    assert write_config_docs(moved, overwrite=True) == 1 and "coastal" in target.read_text()
    again = parse_documents(scan_config_docs(spark, str(tmp_path / "out"))).withColumn("config_dir", F.lit("d"))
    assert same_document(again, good.withColumn("config_dir", F.lit("d"))).first().is_same
    assert [p.name for p in (tmp_path / "out" / "deep").iterdir()] == ["configure_slurm.json"]


def test_manifest_sink(spark, tmp_path):
    path, schema = str(tmp_path / "jobs"), "config_dir string, job int"
    kept = lambda: sorted((r.config_dir or "", r.job) for r in spark.read.schema("job int, config_dir string").parquet(path).collect())
    write_job_manifest(spark.createDataFrame([("/a=1", 1), ("/a=1", 2), (None, 3)], schema), path)
    write_job_manifest(spark.createDataFrame([("/a=1", 9), ("/b", 4), (None, 9), ("2020", 5)], schema), path)
    assert kept() == [("", 3), ("/a=1", 1), ("/a=1", 2), ("/b", 4), ("2020", 5)]
    write_job_manifest(spark.createDataFrame([("/b", 6), ("/c", 7)], schema), path, overwrite=True)
    assert kept() == [("", 3), ("/a=1", 1), ("/a=1", 2), ("/b", 6), ("/c", 7), ("2020", 5)]
    write_job_manifest(spark.createDataFrame([], schema), path)
    assert len(kept()) == 6


def test_manifest_of_many_configurations_has_few_folders(spark, tmp_path):
    path, n = str(tmp_path / "jobs"), 2000
    name = F.concat(F.lit("/c/"), F.col("id"))
    rows = spark.range(n).select(name.alias("config_dir"), F.col("id").alias("job"))
    kept = lambda: {r.config_dir: (r.job, r.note) for r in spark.read.schema("job bigint, note string, config_dir string").parquet(path).collect()}
    write_job_manifest(rows.where("id % 3 <> 0").withColumn("note", F.lit("first")), path)
    write_job_manifest(rows.withColumn("job", -F.col("job")), path)
    write_job_manifest(rows.where("id = 4 or id = 6").withColumn("job", F.col("job") + n), path, overwrite=True)
    wanted = {f"/c/{i}": (i, "first") if i % 3 else (-i, None) for i in range(n)}
    assert kept() == wanted | {"/c/4": (4 + n, None), "/c/6": (6 + n, None)}
    assert len([p for p in (tmp_path / "jobs").iterdir() if p.is_dir()]) <= MANIFEST_PARTS
    rows.where("id < 2").write.partitionBy("config_dir").parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="folder for each configuration"):
        write_job_manifest(rows, str(tmp_path / "old"))


def test_lines_of_one_snapshot_are_dealt_over_tasks(spark):
    lines = spark.range(2000).select(F.lit("q").alias("path"), (F.col("id") + 5).alias("line_no"), F.concat(F.lit(" n"), F.col("id"), F.lit(" /w 7")).alias("line"))
    odd = spark.createDataFrame([("q", 0, "NAME WORK_DIR"), ("q", 1, "short"), ("r", 9, "a /first"), ("r", 8, "head er"), ("r", None, "no place"), (None, 3, "no path")], "path string, line_no bigint, line string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = parse_job_queue(lines.unionByName(odd)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {(r.job_name, r.workdir, r.job_id, r.line_no) for r in found} == {("a", "/first", None, 9)} | {(f"n{i}", "/w", "7", i + 5) for i in range(2000)}
    assert len(found) == 2001 and len({r.task for r in found}) > 2


def plain_lines(data):
    place, out = 0, []
    for line in data.splitlines(True):
        out.append((place, line.rstrip(b"\r\n")))
        place += len(line)
    return out


def test_ranges_give_each_line_once():
    rnd = random.Random(3)
    for _ in range(3000):
        data = b"".join(rnd.choice([b"a", b"\xc3\xa9", b"\n", b"\r", b"\r\n"]) for _ in range(rnd.randrange(40)))
        cuts = sorted({0, len(data), *(rnd.randrange(len(data) + 1) for _ in range(rnd.randrange(5)))})
        got = []
        for start, stop in zip(cuts, cuts[1:]):
            got += [(at, line) for at, line, _ in lines_between(io.BytesIO(data), start, stop, None, rnd.choice([1, 2, 5, 100]))]
        assert got == plain_lines(data)


def test_reading_from_a_listing(spark, tmp_path):
    (tmp_path / "crlf.log").write_bytes(b"one\r\ntwo\rthree\n\nlast")
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "bad.log").write_bytes(b"a\xffb\n")
    rows = [(str(tmp_path / n), os.path.getsize(tmp_path / n)) for n in ("crlf.log", "empty.log", "bad.log")]
    rows += [(str(tmp_path / "gone"), 5), (None, 3), (str(tmp_path / "crlf.log"), None)]
    files = spark.createDataFrame(rows, "path string, length bigint")
    for span in (3, 1000):
        got = sorted((os.path.basename(r.path), r["at"], r.line) for r in read_lines(files, span).collect())
        assert got == [("bad.log", 0, "a\ufffdb"), ("crlf.log", 0, "one"), ("crlf.log", 5, "two"), ("crlf.log", 9, "three"), ("crlf.log", 15, ""), ("crlf.log", 16, "last")]
    whole = {os.path.basename(r.path): r.raw for r in read_texts(files.limit(4)).collect()}
    assert whole == {"crlf.log": "one\r\ntwo\rthree\n\nlast", "empty.log": "", "bad.log": "a\ufffdb\n"}


def test_a_file_under_two_roots_is_read_once(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "ADCIRC_X_y.out.log").write_text("a\nb\n")
    assert scan_log_lines(spark, [str(tmp_path), str(tmp_path / "run")]).count() == 2


def test_tree_comparison(spark, tmp_path):
    for side, text in (("test", "# made now\na\nB\nc\nend 1\n"), ("ref", "# made then\na\nb\nc\nend 2\n")):
        (tmp_path / side / "sub").mkdir(parents=True)
        (tmp_path / side / "sub" / "fort.15").write_text(text)
        (tmp_path / side / "x.nc").write_text(text if side == "ref" else text + "longer")
    (tmp_path / "test" / "only_here").write_text("x\n")
    test, ref = (scan_tree_lines(spark, str(tmp_path / side)) for side in ("test", "ref"))
    rows = {(r.rel_path, r.line_no, r.test_line, r.reference_line) for r in diff_trees(test, ref, {"fort.15": [0, -1]}).collect()}
    assert rows == {("sub/fort.15", 3, "B", "b")}
    listing = lambda side: scan_run_files(spark, [str(tmp_path / side)])
    assert [r.rel_path for r in diff_sizes(listing("test"), listing("ref")).collect()] == ["x.nc"]

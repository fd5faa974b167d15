"""Submission order, classes of meshes and the committed sink of documents."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.mesh import mesh_classes
from fleetlens.operators.order import cycle_problems, submission_levels, submission_order
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources.document_sink import DocumentFiles, committed

EDGES = "config_dir string, src_job string, dst_job string"


def test_levels_places_and_cycles(spark):
    rows = [("a", "s", "r"), ("a", "s", "r"), ("a", "r", "c"), ("a", "s", "c"), (None, "s", "r"), ("b", "x", "y"), ("b", "y", "x"), ("b", "y", "z"), ("b", "w", "x")]
    rows += [("c", "self", "self"), ("c", None, "n"), ("c", "n", None)]
    edges = spark.createDataFrame(rows, EDGES)
    got = {(r.config_dir, r.name): (r.level, r.place) for r in submission_order(edges).collect()}
    assert got == {
        ("a", "s"): (0, 1), ("a", "r"): (1, 2), ("a", "c"): (2, 3), (None, "s"): (0, 1), (None, "r"): (1, 2),
        ("b", "w"): (0, 1), ("b", "x"): (None, None), ("b", "y"): (None, None), ("b", "z"): (None, None), ("c", "self"): (None, None),
    }
    assert {tuple(r) for r in cycle_problems(edges).collect()} == {("b", "x", "y"), ("b", "y", "x"), ("c", "self", "self")}
    assert submission_levels(edges.limit(0)).count() == 0


def test_classes_equal_those_of_pairs(spark):
    rnd = random.Random(4)
    meshes = {}
    for i in range(24):
        rows = [(rnd.randrange(3), rnd.choice([1.0, None])) for _ in range(rnd.randrange(1, 4))]
        meshes[f"m{i:02}"] = rows
        if i % 3 == 0:
            meshes[f"n{i:02}"] = rnd.sample(rows, len(rows))
    table = [(name, *row) for name, rows in meshes.items() for row in rows]
    rnd.shuffle(table)
    frame = spark.createDataFrame(table, "mesh_id string, node int, x double")
    wanted = {}
    for name, rows in meshes.items():
        equal = sorted(other for other, more in meshes.items() if Counter(more) == Counter(rows))
        wanted[name] = (equal[0], len(equal))
    for confirm in (True, False):
        assert {r.mesh_id: (r.class_id, r.members) for r in mesh_classes(frame, ["node", "x"], confirm).collect()} == wanted
    assert mesh_classes(frame.limit(0), ["node", "x"]).count() == 0


def test_equal_prints_are_confirmed_by_rows(spark, monkeypatch):
    from fleetlens.operators import mesh

    plain = mesh.mesh_prints
    monkeypatch.setattr(mesh, "mesh_prints", lambda rows, columns: plain(rows, columns).withColumn("print", F.lit(1)))
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("c", 1)], "mesh_id string, node int")
    assert {(r.mesh_id, r.class_id) for r in mesh.mesh_classes(frame, ["node"]).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def documents(spark, folder, n, fail_at=None):
    name = F.concat(F.lit("configure_"), "id", F.lit(".json"))
    raw = F.concat(F.lit("text "), "id")
    if fail_at is not None:
        raw = F.when(F.col("id") == fail_at, F.raise_error(F.lit("broken"))).otherwise(raw)
    return spark.range(0, n, 1, 4).select(F.concat(F.lit(f"{folder}/"), F.col("id") % 3).alias("config_dir"), name.alias("file_name"), raw.alias("raw"))


def files_below(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)


def test_documents_are_committed_as_one(spark, tmp_path):
    spark.dataSource.register(DocumentFiles)
    folder = tmp_path / "out"

    def write(rows, job, overwrite="false"):
        job = f"{ensure_checkpoint_dir(spark)}/{tmp_path.name}-{job}"
        rows.write.format("document_files").mode("append").option("job", job).option("overwrite", overwrite).save()
        return committed(job)

    with pytest.raises(Exception, match="broken"):
        write(documents(spark, folder, 40, fail_at=39), "failed")
    assert files_below(folder) == []
    assert write(documents(spark, folder, 30), "first") == 30
    assert write(documents(spark, folder, 40), "second") == 10
    assert write(documents(spark, folder, 5), "third", "true") == 5
    found = files_below(folder)
    assert len(found) == 40 and all(os.path.basename(f).startswith("configure_") for f in found)
    assert all(open(f).read() == "text " + f.split("_")[-1].removesuffix(".json") for f in found)


def test_only_accepted_tasks_leave_documents(tmp_path):
    import pyarrow as pa

    batch = lambda text: iter([pa.RecordBatch.from_pydict({"config_dir": [str(tmp_path / "d")], "file_name": ["x"], "raw": [text]})])
    writer = DocumentFiles({"job": str(tmp_path / "job")}).writer(None, False)
    lost, kept, doubled = (writer.write(batch(text)) for text in ("lost", "kept", "doubled"))
    assert [m.written for m in (lost, kept, doubled)] == [1, 1, 1] and not (tmp_path / "d" / "x").exists()
    writer.commit([kept, None])
    assert (tmp_path / "d" / "x").read_text() == "kept" and len(list((tmp_path / "d").iterdir())) == 1
    assert committed(str(tmp_path / "job")) == 1
    again = DocumentFiles({"job": str(tmp_path / "other"), "overwrite": "true"}).writer(None, False)
    again.abort([again.write(batch("new")), None])
    assert (tmp_path / "d" / "x").read_text() == "kept" and len(list((tmp_path / "d").iterdir())) == 1

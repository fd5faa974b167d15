import random

import pytest
from pyspark.sql import functions as F

from fleetlens.sources.boundaries import read_boundaries

SCHEMA = "mesh_id string, line_no bigint, line string"


def plain(lines):
    """Boundary nodes of one tail, read line by line."""
    numbers = [w for w in (line.split() for line in lines) if w and w[0].lstrip("-").isdigit()]
    out, at = [], 0
    for is_open in (True, False):
        if at >= len(numbers):
            break
        blocks, at = int(numbers[at][0]), at + 2
        for boundary in range(1, blocks + 1):
            if at >= len(numbers):
                break
            n, kind = int(numbers[at][0]), None
            if not is_open and len(numbers[at]) > 1 and numbers[at][1].isdigit():
                kind = int(numbers[at][1])
            out += [(is_open, boundary, kind, pos + 1, int(w[0])) for pos, w in enumerate(numbers[at + 1 : at + 1 + n])]
            at += n + 1
    return out


def found(spark, meshes):
    rows = [(name, 100 + i, line) for name, lines in meshes.items() for i, line in enumerate(lines)]
    random.Random(5).shuffle(rows)
    tail = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.split(F.trim("line"), r"\s+"))
    return sorted(map(tuple, read_boundaries(tail).collect()), key=str)


def wanted(meshes):
    return sorted(((name, *row) for name, lines in meshes.items() for row in plain(lines)), key=str)


def tail(rnd, n_open, n_land, longest):
    lines = []
    for blocks, is_open in ((n_open, True), (n_land, False)):
        lines += [f"{blocks} ! boundaries", "99 = nodes"]
        for _ in range(blocks):
            n = rnd.randrange(longest + 1)
            lines.append(f"{n}" if is_open or rnd.random() < 0.2 else f" {n} {rnd.choice([0, 20, 21])} = kind")
            # small ids look like counts and so make false headers
            lines += [f"{rnd.randrange(12)}  text" for _ in range(n)]
    return lines


def test_random_tails(spark):
    rnd = random.Random(3)
    meshes = {f"m{i}": tail(rnd, rnd.choice([0, 1, 2, 9]), rnd.choice([0, 1, 5, 33]), 6) for i in range(12)}
    for name in ("m3", "m7"):
        meshes[name].insert(4, "")
        meshes[name].insert(1, "a remark")
    meshes |= {f"cut {n}": meshes["m5"][:n] for n in (1, 2, 3, 7)} | {"after": meshes["m1"] + ["5", "7", "8"]}
    assert found(spark, meshes) == wanted(meshes)


@pytest.mark.parametrize("broken", [["-1", "0", "1", "4"], ["99999999999999999999", "0", "1", "4"], ["text"], ["1", "1", "-3", "4", "1"]])
def test_counts_that_end_a_tail(spark, broken):
    good = ["1", "1", "2", "5", "6", "0", "0"]
    assert found(spark, {"broken": broken, "good": good}) == wanted({"good": good})


def test_one_long_mesh_spreads_over_tasks(spark):
    rnd = random.Random(8)
    meshes = {"long": tail(rnd, 300, 700, 40), "other": tail(rnd, 1, 1, 3)}
    rows = [(name, i, line) for name, lines in meshes.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.split(F.trim("line"), r"\s+"))
    nodes = read_boundaries(lines)
    assert sorted(map(tuple, nodes.collect()), key=str) == wanted(meshes)
    # no exchange of the result is by mesh alone
    plan = nodes._jdf.queryExecution().toString()
    assert "hashpartitioning(mesh_id" in plan and not any("hashpartitioning(mesh_id" in p and "at" not in p for p in plan.splitlines() if "Exchange" in p)


def test_long_block_is_listed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("fleetlens.sources.boundaries.PIECE", 4)
    meshes = {"m": ["1", "21", "21", *map(str, range(21)), "1", "4", "4 20", *"1234"]}
    assert found(spark, meshes) == wanted(meshes)


def test_no_tails(spark):
    assert found(spark, {}) == []

"""Growing logs as a stream, and the live state of runs."""

import json
import os
import random
import uuid
from collections import Counter

import pytest

from fleetlens.operators.status import run_status
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources.run_files import scan_run_files
from fleetlens.sources.text import scan_log_lines
from fleetlens.streaming.live_status import latest_states, write_states
from fleetlens.streaming.log_tail import LogTail, end_of_last_line, tail_log_lines


def reader(root, state, **options):
    given = {"roots": json.dumps([str(root)]), "state": str(state), "glob": "*.log", "shards": "3", **options}
    return LogTail(given).streamReader(None)


def read(source, start, end):
    return [row for part in source.partitions(start, end) for row in source._rows(part)]


@pytest.mark.parametrize("span", [1, 7, 40, 10_000])
def test_each_line_once_however_a_log_grows(tmp_path, span):
    rnd = random.Random(span)
    root, state = tmp_path / "runs", tmp_path / "state"
    names = [root / f"r{i % 4}" / f"l{i}.log" for i in range(9)]
    for name in names:
        name.parent.mkdir(parents=True, exist_ok=True)
    source, offset, got = reader(root, state, span=str(span)), None, Counter()
    offset = source.initialOffset()
    for turn in range(25):
        for name in rnd.sample(names, 4):
            with open(name, "ab") as out:
                out.write(b"".join(rnd.choice([b"ab", "é".encode(), b"\n", b"\r", b"\r\n", b"x" * 30]) for _ in range(rnd.randrange(8))))
        if turn % 7 == 3:
            source = reader(root, state, span=str(span))
        end = source.latestOffset()
        rows = read(source, offset, end)
        assert Counter(read(source, offset, end)) == Counter(rows)
        got.update(rows)
        source.commit(end)
        offset = end
    wanted = Counter()
    for name in names:
        data = name.read_bytes() if name.exists() else b""
        place = 0
        for line in data.splitlines(True):
            # a carriage return at the end of a file may be half of an end of line
            if line.endswith(b"\n") or line.endswith(b"\r") and place + len(line) < len(data):
                wanted[(str(name), place, line.rstrip(b"\r\n").decode())] += 1
            place += len(line)
    assert got == wanted and len(wanted) > 50
    assert [n for n in os.listdir(state) if n.startswith("snapshot")] == [f"snapshot-{offset['snapshot']}"]


def test_a_shortened_log_is_read_again_and_unchanged_logs_take_no_snapshot(tmp_path):
    root = tmp_path / "runs"
    root.mkdir()
    (root / "a.log").write_text("one\ntwo\n")
    source = reader(root, tmp_path / "state")
    first = source.latestOffset()
    assert source.latestOffset() == first == {"snapshot": 1}
    (root / "a.log").write_text("new\n")
    second = source.latestOffset()
    assert [r[2] for r in read(source, first, second)] == ["new"]
    (root / "a.log").unlink()
    third = source.latestOffset()
    assert third != second and read(source, second, third) == [] and read(source, first, first) == []
    with pytest.raises(FileNotFoundError):
        source.commit(third)
        read(source, first, third)


def test_end_of_last_line(tmp_path):
    path = tmp_path / "x"
    for data, wanted in ((b"", 0), (b"abc", 0), (b"a\nb", 2), (b"a\r\n", 3), (b"a\r", 0), (b"a\rb\r", 2), (b"a\n" + b"x" * 200_000, 2), (b"a\n\r", 2)):
        path.write_bytes(data)
        with open(path, "rb") as source:
            assert end_of_last_line(source, len(data)) == wanted


def test_stream_follows_appends_and_restarts(spark, tmp_path):
    log, folder = tmp_path / "runs" / "a" / "ADCIRC_X_1.out.log", f"{ensure_checkpoint_dir(spark)}/tail-{uuid.uuid4().hex}"
    log.parent.mkdir(parents=True)

    def start():
        lines = tail_log_lines(spark, [str(tmp_path / "runs")], f"{tmp_path}/state", shards=2, span=8)
        return lines.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").start()

    query = start()
    try:
        for n, text in enumerate(("first\nsec", "ond\nthird\n", "fourth\nfifth")):
            with open(log, "a") as out:
                out.write(text)
            if n == 2:  # a restart takes up where the checkpoint ends
                query.stop()
                query = start()
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.line_no, r.line) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(0, "first"), (6, "second"), (13, "third"), (19, "fourth")]
    assert spark.read.parquet(f"{folder}/out").select("run_path", "file_name").distinct().collect() == [(str(log.parent), log.name)]


@pytest.fixture
def rocksdb(spark):
    pytest.importorskip("google.protobuf")
    from fleetlens.streaming.live_runs import use_rocksdb

    use_rocksdb(spark)
    # with timers, batches without data run on end, so waiting for all data would not end either
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def out_log(rnd):
    return rnd.choice(["12.5% COMPLETE", "40.25% COMPLETE", "0.0% COMPLETE", "error: lost", "End Epilogue", "step", "100.0% COMPLETE"])


def fleet(rnd, root):
    """Logs of runs of both models, as lists of lines."""
    logs = {}
    for i in range(14):
        run = f"{root}/run_{i}"
        schism = i % 3 == 0
        markers = ("hgrid.gr3", "vgrid.in", "param.nml", "bctides.in") if schism else ("fort.14", "fort.15", "fort.16")
        os.makedirs(f"{run}/outputs")
        for name in markers:
            open(f"{run}/{name}", "w").write("x")
        kind = "SCHISM" if schism else "ADCIRC"
        for part in ("SETUP", "COLDSTART", "HOTSTART")[: rnd.randrange(1, 4)]:
            lines = [out_log(rnd) for _ in range(rnd.randrange(1, 7))]
            logs[f"{run}/{kind}_{part}_x.out.log"] = ["step" if schism and "error" in line else line for line in lines]
        if schism:
            steps = [f"TIME STEP= {rnd.randrange(900)}; x" for _ in range(rnd.randrange(4))]
            logs[f"{run}/outputs/mirror.out"] = [" time stepping begins...   1   800", *steps]
        if rnd.random() < 0.2:
            logs[f"{run}/{kind}_HOTSTART_x.err.log"] = ["srun: task 0"]
    return logs


def test_live_state_equals_the_batch_report(spark, tmp_path, rocksdb):
    from fleetlens.streaming.live_runs import live_run_status

    rnd, root = random.Random(21), str(tmp_path / "runs")
    logs = fleet(rnd, root)
    folder = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    lines = tail_log_lines(spark, [root], f"{tmp_path}/state", shards=2)
    query = write_states(live_run_status(lines), folder, compact_every=2).trigger(processingTime="0 seconds").start()
    try:
        for turn in range(3):
            for path, content in logs.items():
                cut = [0, len(content) // 3, len(content) // 2, len(content)]
                with open(path, "a") as out:
                    out.write("".join(f"{line}\n" for line in content[cut[turn] : cut[turn + 1]]))
            query.processAllAvailable()
    finally:
        query.stop()
    fields = ("run_path", "model", "status", "progress")
    live = {tuple(r[f] for f in fields) for r in latest_states(spark, folder).collect()}
    batch = {tuple(r[f] for f in fields) for r in run_status(scan_run_files(spark, [root]), scan_log_lines(spark, [root])).collect()}
    assert live == batch and len({status for _, _, status, _ in batch}) == 3
    kept = [n for n in os.listdir(f"{folder}/states".removeprefix("file:")) if "=" in n]
    assert len(kept) <= 2 and any(n.startswith("upto=") for n in kept)


def test_lines_in_any_order_and_expiry(spark, tmp_path, rocksdb):
    from fleetlens.streaming.live_runs import live_run_status

    rnd = random.Random(5)
    rows = [("/r/a", "ADCIRC_RUN_x.out.log", i * 10, out_log(rnd)) for i in range(40)] + [("/r/b", "ADCIRC_RUN_x.out.log", 0, "End Epilogue")]
    rows += [(None, "ADCIRC_RUN_x.out.log", 0, "error"), ("/r/a", "notes.txt", 0, "error"), ("/r/a", None, 3, "error")]
    schema = "run_path string, file_name string, line_no bigint, line string"
    rnd.shuffle(rows)
    source = str(tmp_path / "lines")
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.mode("append").parquet(source)
    folder = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = write_states(live_run_status(stream, expiry_ms=3_600_000), folder).trigger(availableNow=True).start()
    query.awaitTermination()
    state = {r.run_path: (r.progress, r.ended, r.has_error) for r in latest_states(spark, folder).collect()}
    mine = sorted((at, line) for run, name, at, line in rows if run == "/r/a" and name == "ADCIRC_RUN_x.out.log")
    last_error = max((at for at, line in mine if line.startswith("error")), default=-1)
    after = [float(line.split("%")[0]) for at, line in mine if at >= last_error and "COMPLETE" in line and not line.startswith("0.0")]
    assert state["/r/a"] == (after[-1] if after else 0.0, any(line == "End Epilogue" for at, line in mine if at >= last_error), last_error >= 0)
    assert state["/r/b"] == (0.0, True, False) and set(state) == {"/r/a", "/r/b"}
    # both runs are forgotten once their time is up: what is kept does not grow
    folder = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    query = write_states(live_run_status(stream, expiry_ms=1), folder).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            progress = query.lastProgress
            if progress and progress["batchId"] > 0 and progress["stateOperators"][0]["numRowsTotal"] == 0:
                break
            query.awaitTermination(1)
        assert latest_states(spark, folder).isEmpty()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        query.stop()

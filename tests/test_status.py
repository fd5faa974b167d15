"""Run state from real directories, one per rule."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.report_tree import rollup_tree
from fleetlens.operators.status import collect_issues, detect_model, outermost_runs, run_records, run_status, unqueued_runs, verbose_record
from fleetlens.plans.backlog import backlog
from fleetlens.plans.fleet_status import fleet_problem_tree, fleet_problems, fleet_records, fleet_report, fleet_status
from fleetlens.sources.run_files import scan_run_files
from fleetlens.sources.sinks import write_status_report
from fleetlens.sources.text import parse_job_queue, scan_log_lines

OUT = "ADCIRC_HOTSTART_x.out.log"
ADCIRC = {"fort.14": "m", "fort.15": "m", "fort.16": "ok"}
SCHISM = {"hgrid.gr3": "m", "vgrid.in": "m", "param.nml": "m", "bctides.in": "m", "outputs/mirror.out": "x\n"}
SLOG = {"SCHISM_HOTSTART_x.out.log": "End Epilogue\n"}
BEGINS = " time stepping begins...           1      626400  x\n"

# name -> files, short status, verbose status
CASES = {
    "running": ({**ADCIRC, OUT: "12.5% COMPLETE\n15.0% COMPLETE\n"}, "running - 15.0%", "running - 15.0%"),
    "finished": ({**ADCIRC, OUT: "100.0% COMPLETE\nEnd Epilogue\n"}, "completed - 100.0%", "completed - 100.0%"),
    "broken": ({**ADCIRC, OUT: "50% COMPLETE\nERROR x\nstep\n"}, "error - 0%", "error - 50.0%"),
    "two_errors": ({**ADCIRC, OUT: "error 1\n7% COMPLETE\nError 2\n9% COMPLETE\nEnd Epilogue\n"}, "error - 9.0%", "error - 9.0%"),
    "error_inside": ({**ADCIRC, OUT: "srun: error: task 0\nEnd Epilogue\n"}, "completed - 0%", "completed - 0%"),
    "err_log": ({**ADCIRC, OUT: "End Epilogue\n", "ADCIRC_SETUP_x.err.log": "srun: error: x\n"}, "error - 0%", "error - 0%"),
    "empty_err_log": ({**ADCIRC, OUT: "End Epilogue\n", "ADCIRC_SETUP_x.err.log": ""}, "completed - 0%", "completed - 0%"),
    "empty_out_log": ({**ADCIRC, OUT: ""}, "running - 0%", "running - 0%"),
    "not_started": ({"fort.14": "m", "fort.15": "m"}, "not_started - 0%", "not_started - 0%"),
    "failed": ({"fort.14": "m", "fort.15": "m", OUT: "End Epilogue\n"}, "failed - 0%", "failed - 0%"),
    "empty_esmf": ({**ADCIRC, OUT: "End Epilogue\n", "PET0.ESMF_LogFile": ""}, "failed - 0%", "failed - 0%"),
    "esmf_error": ({**ADCIRC, OUT: "End Epilogue\n", "PET0.ESMF_LogFile": "info\nERROR y\n"}, "error - 0%", "error - 0%"),
    "two_logs": ({**ADCIRC, "ADCIRC_A_x.out.log": "End Epilogue\n", "ADCIRC_B_x.out.log": "3% COMPLETE\nEnd Epilogue\n"},
                 "completed - 3.0%", "completed - 3.0%"),
    "trailing_zero": ({**ADCIRC, OUT: "40% COMPLETE\n0% COMPLETE\nEnd Epilogue\n"}, "completed - 40.0%", "completed - 40.0%"),
    "small_output": ({**ADCIRC, OUT: "End Epilogue\n", "fort.63.nc": "x" * 43081}, "not_started - 0%", "not_started - 0%"),
    "large_output": ({**ADCIRC, OUT: "End Epilogue\n", "fort.63.nc": "x" * 43082}, "completed - 0%", "completed - 0%"),
    "schism_running": ({**SCHISM, **SLOG, "outputs/mirror.out": BEGINS + "TIME STEP=     62640; x\n"}, "completed - 10.0%", "completed - 10.0%"),
    "schism_rounded": ({**SCHISM, **SLOG, "outputs/mirror.out": " time stepping begins... 1 40000\nTIME STEP= 1070; x\n"},
                       "completed - 2.67%", "completed - 2.67%"),
    "schism_finished": ({**SCHISM, **SLOG, "outputs/mirror.out": BEGINS + "Run completed successfully at x\nTIME STEP= 1; x\n"},
                        "completed - 100%", "completed - 100%"),
    "schism_no_total": ({**SCHISM, **SLOG, "outputs/mirror.out": "TIME STEP=     62640; x\n"}, "completed - 0%", "completed - 0%"),
    "schism_zero_total": ({**SCHISM, **SLOG, "outputs/mirror.out": " time stepping begins... 1 0\nTIME STEP= 5; x\n"},
                          "completed - 0%", "completed - 0%"),
    "schism_waiting": (SCHISM, "not_started - 0%", "not_started - 0%"),
    "schism_error_text": ({**SCHISM, "SCHISM_HOTSTART_x.out.log": "ERROR in text\n"}, "running - 0%", "running - 0%"),
    "schism_small": ({**SCHISM, **SLOG, "outputs/schout_1.nc": "x"}, "not_started - 0%", "not_started - 0%"),
    "neither": ({"fort.14": "m", OUT: "End Epilogue\n"}, None, None),
}


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


@pytest.fixture(scope="module")
def fleet_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet dir+1")
    for name, (files, _, _) in CASES.items():
        write(root / "runs" / name, files)
    (root / "nothing").mkdir()
    write(root / "runs" / "finished" / "nested", {**ADCIRC})
    return root


@pytest.fixture(scope="module")
def tables(spark, fleet_dir):
    root = str(fleet_dir)
    return scan_run_files(spark, [root]).cache(), scan_log_lines(spark, [root]).cache()


@pytest.mark.parametrize("verbose", [False, True])
def test_every_rule(tables, verbose):
    got = {r.run_name: r.status_text for r in run_status(*tables, verbose=verbose).collect() if r.run_name != "nested"}
    assert got == {name: case[2 if verbose else 1] for name, case in CASES.items() if case[1]}


def test_issue_rows_give_the_same_status(tables):
    files, lines = tables
    for verbose in (False, True):
        worst = {r.run_path: r.s for r in collect_issues(files, lines, verbose=verbose).groupBy("run_path").agg(F.max("severity").alias("s")).collect()}
        for run in run_status(files, lines, verbose=verbose).collect():
            assert worst.get(run.run_path, 0) == run.severity, run


def test_messages(tables):
    def messages(name, verbose):
        rows = collect_issues(*tables, verbose=verbose).where(F.col("run_path").endswith("/" + name)).orderBy("line_no").collect()
        return [(r.category, r.file_name, r.message) for r in rows]

    assert [m for m in messages("two_errors", False)] == [("error", OUT, "Error 2")]
    assert [m[2] for m in messages("two_errors", True)] == ["error 1", "Error 2"]
    assert messages("small_output", False)[0][2] == "file size (43081) does not exceed the minimum file size (43081)"
    assert ("failed", "mirror.out") not in [m[:2] for m in messages("schism_waiting", False)]


def test_not_configured_on_direct_check(tables):
    files, lines = tables
    status = {r.run_name: r.status for r in run_status(files, lines, model="ADCIRC").collect()}
    assert status["neither"] == "not_configured"
    keys = collect_issues(files, lines, model="ADCIRC").where("category = 'not_configured'").select("file_name").distinct().collect()
    assert [k.file_name for k in keys] == ["fort.14,fort.15"]


def test_verbose_records_hold_the_whole_report(spark, fleet_dir):
    records = [r for r in fleet_problems(spark, [str(fleet_dir)]).collect() if r.run_name == "two_errors"]
    merged = {}
    for r in records:
        for key, value in json.loads(r.record).items():
            merged[key] = {**merged.get(key, {}), **value} if isinstance(value, dict) else value
    assert merged == {"status": "error", "progress": "9.0%", "error": {OUT: ["error 1", "Error 2"]}}


def test_one_record_per_run(spark, fleet_dir, tables):
    records = fleet_records(spark, [str(fleet_dir)]).collect()
    names = [r.run_name for r in records]
    assert len(names) == len(set(names)) and {r.piece for r in records} == {0}
    (record,) = [json.loads(r.record) for r in records if r.run_name == "two_errors"]
    assert record == {"status": "error", "progress": "9.0%", "error": {OUT: ["error 1", "Error 2"]}}
    assert all("piece" not in json.loads(r.record) for r in records if r.status == "completed")


def test_long_runs_go_on_in_further_records(spark, fleet_dir, tables):
    files, lines = tables
    status, issues = run_status(files, lines, verbose=True), collect_issues(files, lines, verbose=True)
    whole = {r.run_path: json.loads(r.record) for r in run_records(status, issues).collect()}
    merged = {}
    for r in sorted(run_records(status, issues, messages_per_record=1).collect(), key=lambda r: (r.run_path, r.piece)):
        into = merged.setdefault(r.run_path, {})
        for key, value in json.loads(r.record).items():
            if isinstance(value, dict):
                for name, messages in value.items():
                    into.setdefault(key, {}).setdefault(name, []).extend(messages)
            else:
                into[key] = value
    assert merged == whole


def test_runs_inside_runs_are_left_out(spark, fleet_dir, tables):
    names = {r.run_name for r in fleet_status(spark, [str(fleet_dir)]).collect()}
    assert "nested" not in names and "finished" in names
    assert "nested" in {r.run_path.split("/")[-1] for r in detect_model(tables[0]).collect()}


def test_outermost_of_odd_paths(spark):
    """Against the rule itself: no directory above a run is a run."""
    rnd = random.Random(3)
    paths = ["".join(rnd.choice(["/", "/", "a", "b", "\x00", "\x01", "\x02", ".", "-", "é"]) for _ in range(rnd.randrange(0, 9))) for _ in range(400)]
    paths += [*(f"/flat/{i}" for i in range(300)), "/flat/7/in", "/flat/7/in", "/flat/7.x", "/flat/7", None, None]
    runs = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n int, run_path string")
    known = set(paths)
    above = lambda p: {"/".join(p.split("/")[:depth]) for depth in range(1, p.count("/") + 1)} - {p}
    found = outermost_runs(runs)
    assert found.columns == ["run_path", "n"]
    assert sorted(r.n for r in found.collect()) == [i for i, p in enumerate(paths) if p is None or not above(p) & known]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_report_order(spark, fleet_dir):
    rows = fleet_status(spark, [str(fleet_dir)], model="ADCIRC").collect()
    assert [r.progress for r in rows] == sorted((r.progress for r in rows), reverse=True)
    assert {r.model for r in rows} == {"ADCIRC"}


def nested_report(runs, prefix):
    """The report by plain recursion, as the brute-force answer."""
    direct = {p: t for p, t in runs.items() if p.startswith(prefix + "/")}
    if prefix in runs:
        return runs[prefix]
    names = sorted({p[len(prefix) + 1:].split("/")[0] for p in direct})
    entries = {name: nested_report(runs, f"{prefix}/{name}") for name in names}
    first = next(iter(entries.values()))
    return first if all(v == first for v in entries.values()) else entries


def flatten(value, path, level=0):
    out = {(path, level, value if isinstance(value, str) else None)}
    if isinstance(value, dict):
        for name, below in value.items():
            out |= flatten(below, f"{path}/{name}", level + 1)
    return out


def test_tree_against_recursion(spark):
    a, b = "completed - 100.0%", "running - 1.0%"
    runs = {
        "/t/one/runs/x": a, "/t/one/runs/y": b,          # a single directory stands for its entries
        "/t/two/p/x": a, "/t/two/p/y": b, "/t/two/q/x": a, "/t/two/q/y": b,  # equal entries fold
        "/t/three/p/x": a, "/t/three/q/x": a,              # one state
        "/t/four/p/x": a, "/t/four/q/z": a, "/t/four/q/w": b,
        "/t/five": b, "/t/six/deep/er/x": a, "/t/six/deep/y": b,
    }
    for keep in (runs, {k: v for k, v in runs.items() if "/one/" in k}, {"/t/only": a}):
        rows = [(p, p.split("/")[-1], t, 0.0, 0) for p, t in keep.items()]
        df = spark.createDataFrame(rows, "run_path string, run_name string, status_text string, progress double, severity int")
        got = {(r.path, r.level, r.text) for r in rollup_tree(df, "/t").collect()}
        assert got == flatten(nested_report(keep, "/t"), "/t")


def test_tree_places_entries(spark):
    rows = [
        ("/t/all/run_10", "running - 1.0%", 1.0, 1), ("/t/all/run_9", "running - 1.0%", 1.0, 1), ("/t/all/other", "error - 50.0%", 50.0, 4),
        ("/t/all/late", "failed - 1.0%", 1.0, 2), ("/t/some/z/a", "running - 1.0%", 1.0, 1), ("/t/some/z/b", "error - 0%", 0.0, 4),
        ("/t/some/a", "error - 0%", 0.0, 4), ("/t/some/b", "running - 9.0%", 9.0, 1), ("/u/all/x", "running - 1.0%", 1.0, 1),
    ]
    df = spark.createDataFrame(rows, "run_path string, status_text string, progress double, severity int")

    def listed(**more):
        found = rollup_tree(df, **more).collect()
        return [(r.path, r.position) for r in sorted(found, key=lambda r: (r.level, r.parent or "", r.position))]

    assert listed(root=["/t/all", "/t/some/", "/none"]) == [
        ("/t/all", 1), ("/t/some", 2), ("/t/all/other", 1), ("/t/all/run_9", 2), ("/t/all/run_10", 3), ("/t/all/late", 4),
        # a directory among the entries: by name
        ("/t/some/a", 1), ("/t/some/b", 2), ("/t/some/z", 3), ("/t/some/z/a", 1), ("/t/some/z/b", 2),
    ]
    # of two roots with one name the last counts
    assert listed(root=["/t/all", "/u/all"]) == [("/u/all", 1)]
    assert listed(root="/")[:3] == [("/", 1), ("/t", 1), ("/u", 2)]
    assert listed(root="/nowhere") == []


def test_tree_with_details_folds_equal_records_only(spark):
    text = "error - 0%"
    rows = [(f"/t/{d}/{r}", text, 0.0, 4) for d in "pq" for r in "xy"]
    df = spark.createDataFrame(rows, "run_path string, status_text string, progress double, severity int")
    found = [(f"/t/{d}/{r}", "error", "log", [f"line {d}", "end"]) for d in "pq" for r in "xy"]
    details = spark.createDataFrame(found, "run_path string, category string, file_name string, messages array<string>")
    assert [r.path for r in rollup_tree(df, "/t").collect()] == ["/t"]
    assert {(r.path, r.text, r.run_path) for r in rollup_tree(df, "/t", details=details).collect()} == {
        ("/t", None, None), ("/t/p", text, "/t/p/x"), ("/t/q", text, "/t/q/x"),
    }


def test_fleet_problem_tree(spark, fleet_dir):
    tree, problems = fleet_problem_tree(spark, str(fleet_dir))
    shown = {r.run_path for r in tree.where("text is not null").collect()}
    broken = [p for p in shown if p.endswith("/broken")]
    assert broken and {r.run_path for r in problems.collect()} <= shown
    assert problems.where(F.col("run_path") == broken[0]).count() >= 1


def test_fleet_report(spark, fleet_dir):
    rows = {r.path[len(str(fleet_dir)):]: r.text for r in fleet_report(spark, str(fleet_dir), "SCHISM").collect()}
    # `runs` is the only entry, so the top stands for what `runs` holds
    assert rows["/schism_finished"] == "completed - 100%" and rows[""] is None


def test_backlog(spark, fleet_dir, tmp_path):
    queue = tmp_path / "queue.txt"
    runs = fleet_dir / "runs"
    queue.write_text(f"NAME WORK_DIR JOBID\nnot_started /old 1\nnot_started /new 2\nADCIRC_HOTSTART_x {runs}/small_output 3\n")
    by_name = [r.run_name for r in backlog(spark, [str(fleet_dir)], str(queue)).collect()]
    assert by_name == ["schism_small", "schism_waiting", "small_output"]


def test_unqueued_by_workdir(spark):
    runs = spark.createDataFrame([("a", "/r/a"), ("b", "/r/b"), ("c", "/r/c")], "run_name string, run_path string")
    queue = spark.createDataFrame([("ADCIRC_HOTSTART_a", "/r/a", "1")], "job_name string, workdir string, job_id string")
    status = spark.createDataFrame([("/r/a", "not_started"), ("/r/b", "not_started"), ("/r/c", "error")], "run_path string, status string")
    assert [r.run_name for r in unqueued_runs(runs, queue, status).collect()] == ["a", "b"]
    assert [r.run_name for r in unqueued_runs(runs, queue, status, match="workdir").collect()] == ["b"]
    with pytest.raises(ValueError):
        unqueued_runs(runs, queue, status, match="id")


@pytest.mark.parametrize("match", ["name", "workdir"])
def test_unqueued_deals_the_lines_of_a_snapshot(spark, match):
    """All lines of a snapshot have one path, so a join by path alone would bring them to one task."""
    runs = spark.range(40).select(F.concat(F.lit("r"), "id").alias("run_name"), F.concat(F.lit("/r/"), "id").alias("run_path"), F.lit("not_started").alias("status"))
    lines = spark.range(200).select(F.lit("q").alias("path"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit(" r"), F.col("id") % 39, F.lit(" /r/"), F.col("id") % 38, F.lit(" 7")).alias("line"))
    header = spark.createDataFrame([("q", 0, "r39 /r/39 1")], "path string, line_no bigint, line string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = unqueued_runs(runs, parse_job_queue(lines.unionByName(header)), runs, match)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = [r.run_name for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"Join \[path#\d+\], \[path#\d+\]", plan) and re.search(r"Join \[path#\d+, _slice#\d+\]", plan)
    assert rows == (["r39"] if match == "name" else ["r38", "r39"])


def test_status_report_sink(spark, tables, tmp_path):
    status = run_status(*tables).where("run_name = 'finished'").withColumn("note", F.lit(None).cast("string"))
    write_status_report(status, str(tmp_path / "report"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert json.loads(line)["status_text"] == "completed - 100.0%" and json.loads(line)["note"] is None

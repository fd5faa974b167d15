"""Ensemble expansion and planning of whole configuration directories."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.checks.config_checks import overlay_config, overlay_stop
from fleetlens.functions.literals import literal_text
from fleetlens.operators.config import (
    dropped_overrides,
    ensemble_members,
    expand_ensemble,
    missing_required,
    move_paths,
    overlay,
    parse_documents,
    relative_to,
)
from fleetlens.operators.planning import job_edges, job_manifest, processor_ranges, step_plan
from fleetlens.plans.ensemble_plan import member_documents, plan_directory, plan_ensembles
from fleetlens.sources.text import scan_config_docs

DRIVER = {
    "platform": "STAMPEDE2",
    "perturbations": {
        "deep": {
            "adcirc": {"IHOT": 5, "processors": 300, "modeled_timestep": 5.0, "modeled_end_time": "2031-07-06 06:00:00"},
            "wavewatch": {"constituents": "all"},
        },
        "plain": None,
    },
}
MODEL = {
    "modeled_start_time": "2031-07-04 06:00:00", "modeled_end_time": "2031-07-09 18:00:00", "modeled_timestep": 3.0,
    "tidal_spinup_duration": 432000.0, "processors": 203, "source_filename": "../site.sh", "attributes": {"IM": None},
}
DOCUMENTS = {
    "modeldriver": DRIVER,
    "slurm": {"account": None, "job_duration": 16200.0},
    "nems": {"interval": 3600.0},
    "adcirc": MODEL,
    "atmesh": {"processors": 1},
    "ww3data": {"nrs": None},
}


def write(folder, documents):
    folder.mkdir()
    for kind, fields in documents.items():
        (folder / f"configure_{kind}.json").write_text(json.dumps(fields))


@pytest.fixture
def ensemble(spark, tmp_path):
    write(tmp_path / "adcirc", DOCUMENTS)
    schism = {k: v for k, v in DOCUMENTS.items() if k in ("slurm",)}
    schism |= {"modeldriver": {"platform": "ORION", "perturbations": None}, "schism": {**MODEL, "schism_use_old_io": True}}
    write(tmp_path / "schism", schism)
    return tmp_path


def test_expansion(spark, ensemble):
    docs = parse_documents(scan_config_docs(spark, [str(ensemble / "adcirc")]))
    members = ensemble_members(docs)
    assert {r.run_name: r.overrides is None for r in members.collect()} == {"plain": True, "deep": False}
    assert [(r.run_name, r.kind) for r in dropped_overrides(docs, members).collect()] == [("deep", "wavewatch")]

    def model_of(run, **kw):
        row = expand_ensemble(docs, **kw).where((F.col("run_name") == run) & (F.col("kind") == "adcirc"))
        return row.select(F.transform_values("fields", lambda _, v: literal_text(v)).alias("f")).first().f

    assert model_of("plain")["modeled_timestep"] == "3" and "IHOT" not in model_of("plain")
    deep = model_of("deep")
    assert (deep["IHOT"], deep["modeled_timestep"], deep["processors"]) == ("5", "5", "300")
    # a base with the same processors: what follows that field is dropped
    same = docs.withColumn("fields", F.when(F.col("kind") == "adcirc", F.map_zip_with("fields", F.create_map(F.lit("processors"), F.lit("300")), lambda k, a, b: F.coalesce(b, a))).otherwise(F.col("fields")))
    row = expand_ensemble(same, stop_at_equal=True).where("run_name = 'deep' and kind = 'adcirc'").select(F.transform_values("fields", lambda _, v: literal_text(v)).alias("f")).first().f
    assert (row["IHOT"], row["modeled_timestep"]) == ("5", "3")
    assert missing_required(docs, "NEMS_ADCIRC").isEmpty()
    assert [r.kind for r in missing_required(docs, "SCHISM").collect()] == ["schism"]


def test_maps_are_replaced_whole(spark):
    docs = spark.createDataFrame([("c", "adcirc", {"attributes": '{"a":1}'})], "config_dir string, kind string, fields map<string,string>")
    members = spark.createDataFrame([("c", "r", {"adcirc": {"attributes": '{"b":2}'}})],
                                    "config_dir string, run_name string, overrides map<string,map<string,string>>")
    assert overlay(docs, members).first().fields == {"attributes": '{"b":2}'}


def broadcasts(frame):
    """Joins that gather a table other than the platforms' on the driver."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum("BroadcastHashJoin" in line and "BroadcastHashJoin [platform#" not in line for line in plan.splitlines())


def test_jobs_gather_only_platforms_on_the_driver(spark, ensemble):
    """Tables that grow with the fleet are not broadcast, however small their sizes look."""
    assert broadcasts(job_manifest(plan_directory(spark, [str(ensemble)]))) == 0


def test_planned_runs_gather_only_platforms_on_the_driver(spark, ensemble):
    plan = plan_ensembles(parse_documents(scan_config_docs(spark, [str(ensemble)])))
    assert broadcasts(plan.runs) == 0
    assert broadcasts(plan.links) == 0


def test_planned_outputs_gather_only_platforms_on_the_driver(spark, ensemble):
    docs = parse_documents(scan_config_docs(spark, [str(ensemble)]))
    plan = plan_ensembles(docs)
    assert broadcasts(plan.outputs) == 0
    assert broadcasts(plan.problems) == 0
    assert broadcasts(member_documents(docs, plan.runs)) == 0


@pytest.mark.parametrize("stop_at_equal", [False, True])
def test_overlay_broadcasts_neither_side(spark, stop_at_equal):
    docs = spark.createDataFrame([("c", "adcirc", {"a": "1", "b": "2"})], "config_dir string, kind string, fields map<string,string>")
    members = spark.createDataFrame([("c", f"r{i}", {"adcirc": {"a": "1", "b": str(i)}}) for i in range(3)],
                                    "config_dir string, run_name string, overrides map<string,map<string,string>>")
    members_docs = overlay(docs, members, stop_at_equal)
    assert broadcasts(members_docs) == 0
    assert {r.run_name: r.fields["b"] for r in members_docs.collect()} == {f"r{i}": "2" if stop_at_equal else str(i) for i in range(3)}


@pytest.mark.parametrize("stop_at_equal", [False, True])
def test_overlay_sorts_no_members(spark, stop_at_equal):
    """Sorted, all members of a task lie in its memory, and maps take many times their compressed size."""
    docs = spark.createDataFrame([("c", "adcirc", {"a": "1"}), ("c", "slurm", {}), ("d", "adcirc", {"a": "3"}), (None, "adcirc", {}), ("e", "adcirc", None)],
                                 "config_dir string, kind string, fields map<string,string>")
    members = spark.createDataFrame([("c", "r", {"adcirc": {"a": "2"}}), ("c", "r", {"adcirc": {"a": "2"}}), ("d", "r", None), (None, "r", None), ("e", "r", None), ("f", "r", None)],
                                    "config_dir string, run_name string, overrides map<string,map<string,string>>")
    found = overlay(docs, members, stop_at_equal)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [config_dir" in plan and "BuildLeft" in plan
    assert "SortMergeJoin" not in plan and "Sort [" not in plan
    rows = sorted((r.config_dir, r.kind, r.fields) for r in found.collect() if r.config_dir != "e")
    assert rows == [("c", "adcirc", {"a": "2"})] * 2 + [("c", "slurm", {})] * 2 + [("d", "adcirc", {"a": "3"})]
    assert [r.fields for r in found.where("config_dir = 'e'").collect()] == [None]


@pytest.mark.parametrize("query", [overlay_config, overlay_stop])
def test_lines_of_members_are_not_sorted_by_file_split(spark, tmp_path, query):
    """Sorted, all lines of a split lie in its task's memory, and a split grows with the input up to the largest one a file is cut into."""
    lines = [(1, 7, 5.0, "R"), (1, 7, 3.0, "A"), (2, 7, 4.0, "N"), (3, 8, 9.0, "R"), (4, None, 1.0, "A"), (None, 7, 2.0, "A"), (5, 7, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, 6, "n", 10.5, "b")], "p_partkey long, p_size int, p_name string, p_retailprice double, p_brand string").write.parquet(
        str(tmp_path / "part.parquet")
    )
    found = query(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "l_partkey" in line)
    dealt = max(i for i, line in enumerate(plan[:scan]) if "Exchange" in line)
    assert not [line for line in plan[dealt:scan] if "Sort" in line or "Aggregate" in line]
    assert any("Sort [l_partkey" in line for line in plan[:dealt])
    values = {(r.run_name, r.field): r.value for r in found.where("kind = 'adcirc'").collect()}
    assert {run: (values[run, "processors"], values[run, "output_surface"], values[run, "fort_14_path"]) for run, _ in values} == {
        "run_1": ("3", "false", "A"), "run_2": ("6", "true", "n"), "run_5": ("6", "true", "n"), None: ("2", "false", "A")
    }


def test_coupled_plan(spark, ensemble):
    runs = plan_directory(spark, [str(ensemble / "adcirc")])
    jobs = {r.job_name: r for r in job_manifest(runs).collect()}
    assert len(jobs) == 6
    # 203 or 300 for the model, 1 each for the two forcings; 68 to a node
    hot, deep = jobs["ADCIRC_HOTSTART_plain"], jobs["ADCIRC_HOTSTART_deep"]
    assert (hot.tasks, hot.nodes, hot.walltime, hot.account, hot.out_log) == (205, 4, "04:30:00", "coastal", "ADCIRC_HOTSTART_plain.out.log")
    assert (deep.tasks, deep.nodes) == (302, 5)
    spinup = jobs["ADCIRC_COLDSTART_SPINUP"]
    assert (spinup.tasks, spinup.nodes) == (203, 3)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    windows = {r.run_name: tuple(r)[1:] for r in runs.select("run_name", text("begin_ts"), text("finish_ts"), "timestep_s").collect()}
    assert windows == {
        "spinup": ("2031-06-29 06:00", "2031-07-04 06:00", 3.0), "plain": ("2031-07-04 06:00", "2031-07-09 18:00", 3.0),
        "deep": ("2031-07-04 06:00", "2031-07-06 06:00", 5.0),
    }
    edges = {(r.src_job, r.dst_job) for r in job_edges(runs).collect()}
    assert edges == {
        ("ADCIRC_SETUP_SPINUP", "ADCIRC_COLDSTART_SPINUP"),
        ("ADCIRC_SETUP_plain", "ADCIRC_HOTSTART_plain"), ("ADCIRC_COLDSTART_SPINUP", "ADCIRC_HOTSTART_plain"),
        ("ADCIRC_SETUP_deep", "ADCIRC_HOTSTART_deep"), ("ADCIRC_COLDSTART_SPINUP", "ADCIRC_HOTSTART_deep"),
    }
    assert {s for e in edges for s in e} == set(jobs)


def test_problems_and_unfit_configurations(spark, ensemble):
    write(ensemble / "twice", {**DOCUMENTS, "modeldriver": {"platform": "MARS"}, "nwm": {"cache": True}})
    write(ensemble / "none", {"slurm": {}})
    docs = parse_documents(scan_config_docs(spark, [str(ensemble)]))
    plan = plan_ensembles(docs)
    found = {(r.config_dir.split("/")[-1], r.problem, r.detail, r.is_fatal) for r in plan.problems.collect()}
    assert found == {
        ("adcirc", "override without document", "wavewatch", False),
        ("twice", "unknown platform", "MARS", True), ("twice", "forcing not supported", "nwm", False),
        ("none", "no model document", None, True), ("none", "no platform", None, True),
    }
    assert {r.config_dir.split("/")[-1] for r in plan.runs.select("config_dir").distinct().collect()} == {"adcirc", "schism"}
    assert {(r.run_path.split("/")[-1], r.variable) for r in plan.outputs.where("run_path like '%adcirc%'").collect()} == {
        (run, v) for run in ("deep", "plain") for v in ("elevation", "velocity")}
    done = plan.runs.where("run_name = 'deep'").select("run_path", F.explode(F.array(*map(F.lit, ["fort.13", "fort.14", "fort.15", "setup.job", "adcirc.job", "nems.configure", "atm_namelist.rc", "model_configure", "config.rc"]))).alias("rel_path"))
    assert {r.run_name for r in plan_ensembles(docs, done).pending.where("model = 'ADCIRC'").collect()} == {"plain", "spinup"}


def test_paths_of_whole_documents(spark, ensemble):
    docs = parse_documents(scan_config_docs(spark, [str(ensemble / "adcirc")]))
    tidal = spark.createDataFrame([(str(ensemble / "adcirc"), "tidal", {"resource": '"grids/h.nc"', "tidal_source": '"TPXO"'})], "config_dir string, kind string, fields map<string,string>")
    docs = docs.select("config_dir", "kind", "fields").unionByName(tidal)
    path = lambda frame, kind, name: literal_value(frame.where(F.col("kind") == kind), name)
    moved = move_paths(docs)
    assert path(moved, "adcirc", "source_filename") == str(ensemble / "site.sh")
    assert path(moved, "tidal", "resource") == str(ensemble / "adcirc" / "grids/h.nc")
    near = relative_to(moved, F.concat("config_dir", F.lit("/runs/a")))
    assert path(near, "adcirc", "source_filename") == "../../../site.sh"
    assert path(near, "tidal", "resource") == str(ensemble / "adcirc" / "grids/h.nc") and path(near, "tidal", "tidal_source") == "TPXO"
    members = member_documents(docs.where("kind <> 'tidal'"), plan_directory(spark, [str(ensemble / "adcirc")]), relative=True)
    assert {literal_value(members.where(f"kind = 'adcirc' and run_name = '{r}'"), "source_filename") for r in ("deep", "plain")} == {"../../../site.sh"}


def literal_value(frame, name):
    return frame.select(literal_text(F.col("fields")[name])).first()[0]


def test_schism_plan(spark, ensemble):
    runs = plan_directory(spark, [str(ensemble / "schism")])
    jobs = {r.job_name for r in job_manifest(runs).collect()}
    assert jobs == {
        "SCHISM_COLDSTART_SPINUP", "SCHISM_COMBINE_HOTSTARTFILES_SPINUP", "SCHISM_HOTSTART_unperturbed",
        "SCHISM_COMBINE_HOTSTARTFILES_unperturbed", "SCHISM_COMBINE_OUTPUTFILES_unperturbed",
    }
    assert {(r.src_job, r.dst_job) for r in job_edges(runs).collect()} == {
        ("SCHISM_COLDSTART_SPINUP", "SCHISM_COMBINE_HOTSTARTFILES_SPINUP"),
        ("SCHISM_COMBINE_HOTSTARTFILES_SPINUP", "SCHISM_HOTSTART_unperturbed"),
        ("SCHISM_HOTSTART_unperturbed", "SCHISM_COMBINE_HOTSTARTFILES_unperturbed"),
        ("SCHISM_HOTSTART_unperturbed", "SCHISM_COMBINE_OUTPUTFILES_unperturbed"),
    }
    plan = step_plan(runs.where("not is_spinup")).first()
    # five and a half days and five days of three-second steps
    assert (plan.restart_steps, plan.output_stacks) == ([158400], 1)
    assert runs.where("is_spinup").first().spinup_step == 144000


def test_schism_attributes_of_a_member(spark, ensemble):
    driver = {"platform": "HERA", "perturbations": {"own": {"schism": {"attributes": {"nhot_write": 600, "ihfskip": 1200, "dt": 100.0, "rnday": 2}}}, "off": {"schism": {"attributes": {"nhot": 0}}}}}
    write(ensemble / "attributes", {"modeldriver": driver, "slurm": {}, "schism": MODEL})
    runs = plan_directory(spark, [str(ensemble / "attributes")])
    got = {r.run_name: (r.nhot, r.nhot_write, r.ihfskip, r.timestep_s, r.duration_s) for r in runs.collect()}
    assert got == {"own": (1, 600, 1200, 100.0, 172800.0), "off": (0, 158400, None, 3.0, 475200.0), "spinup": (1, 144000, None, 3.0, 475200.0)}
    plan = step_plan(runs.where("run_name = 'own'")).first()
    assert (plan.restart_steps, plan.output_stacks) == ([600, 1200, 1800], 2)
    assert "SCHISM_COMBINE_HOTSTARTFILES_off" not in {r.job_name for r in job_manifest(runs).collect()}


def test_ranges(spark):
    components = spark.createDataFrame([("c", 0, "ATM", 2), ("c", 1, "WAV", 3), ("c", 2, "OCN", 70), ("d", 0, "OCN", 4)],
                                       "config_dir string, pos int, component string, processors int")
    rows = processor_ranges(components).orderBy("config_dir", "pos").collect()
    assert [(r.lo, r.hi) for r in rows] == [(0, 1), (2, 4), (5, 74), (0, 3)]


def test_times_do_not_depend_on_the_session_zone(spark, ensemble):
    """In this zone the start time does not exist and the first day has 23 hours."""
    from fleetlens.operators.config import to_document

    model = {**MODEL, "modeled_start_time": "2031-03-09 02:30:00", "modeled_end_time": "2031-03-10 02:30:00"}
    write(ensemble / "gap", {**DOCUMENTS, "adcirc": model})
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        run = plan_directory(spark, [str(ensemble / "gap")]).where("run_name = 'plain'").select("duration_s", F.col("finish_ts").cast("string").alias("t")).first()
        assert (run.duration_s, run.t) == (86400.0, "2031-03-10 02:30:00")
        docs = parse_documents(scan_config_docs(spark, [str(ensemble / "gap")])).where("kind = 'adcirc'")
        assert json.loads(to_document(docs).first().raw)["modeled_start_time"] == "2031-03-09 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)

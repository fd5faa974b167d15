"""Run planning: windows, jobs, dependencies, processors and outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import shift_seconds, walltime
from ..functions.names import job_name, node_count
from ..schemas import (
    DEFAULT_JOB_SECONDS,
    PLATFORM_SCHEMA,
    PLATFORMS,
    WRITTEN_FILE_ASWIP,
    WRITTEN_FILES,
    WRITTEN_FILES_COUPLED,
)


def platform_dim(spark) -> DataFrame:
    """The five platforms, marked for broadcast (their number is fixed)."""
    return F.broadcast(spark.createDataFrame(PLATFORMS, PLATFORM_SCHEMA))


def with_platform(df: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """Account, partition and tasks filled from the platform; its launcher and node size added.

    Columns ``account``, ``partition`` and ``tasks`` are created when the input lacks them.
    """
    platforms = platform_dim(df.sparkSession) if platforms is None else platforms
    out = df
    for name, kind in (("account", "string"), ("partition", "string"), ("tasks", "bigint")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return (
        out.join(platforms, "platform", "left")
        .withColumn("account", F.coalesce("account", "default_account"))
        .withColumn("partition", F.coalesce("partition", "default_partition"))
        .withColumn("tasks", F.coalesce("tasks", F.col("processors_per_node").cast("bigint")))
        .drop("default_account", "default_partition")
    )


def all_runs(configs: DataFrame, members: DataFrame) -> DataFrame:
    """Member runs and the spinup run of each configuration that has a spinup duration.

    ``configs`` has a row per configuration: ``config_dir, model, coupled, spinup_s`` and any
    columns the jobs need. Coupled SCHISM configurations cannot be planned and are left out.
    Neither side is broadcast: both grow with the fleet.
    """
    plannable = configs.where(~((F.col("model") == "SCHISM") & F.coalesce(F.col("coupled"), F.lit(False))))
    runs = plannable.join(members.select("config_dir", "run_name").hint("merge"), "config_dir").withColumn("is_spinup", F.lit(False))
    spinups = (
        plannable.where("spinup_s is not null")
        .withColumn("run_name", F.lit("spinup"))
        .withColumn("is_spinup", F.lit(True))
    )
    return runs.unionByName(spinups)


def rejected_configs(configs: DataFrame) -> DataFrame:
    return configs.where((F.col("model") == "SCHISM") & F.col("coupled"))


def run_window(runs: DataFrame) -> DataFrame:
    """Add ``phase`` and the time window ``[begin_ts, finish_ts]`` of each run.

    A run goes from ``start_ts`` for ``duration_s``; its spinup goes from ``spinup_s`` before to
    ``start_ts``. Runs that follow a spinup are hot starts.
    """
    return runs.select(
        "*",
        F.when(F.col("spinup_s").isNotNull() & ~F.col("is_spinup"), "HOTSTART").otherwise("COLDSTART").alias("phase"),
        F.when(F.col("is_spinup"), shift_seconds(F.col("start_ts"), -F.col("spinup_s")))
        .otherwise(F.col("start_ts"))
        .alias("begin_ts"),
        F.when(F.col("is_spinup"), F.col("start_ts"))
        .otherwise(shift_seconds(F.col("start_ts"), F.col("duration_s")))
        .alias("finish_ts"),
    )


def _label() -> Column:
    return F.when(F.col("is_spinup"), F.lit("SPINUP")).otherwise(F.col("run_name"))


def _named(job_type: str) -> Column:
    return job_name(F.col("model"), F.lit(job_type), F.col("phase"), _label())


def _combines_hotstart() -> Column:
    run_writes = (F.col("nhot") == 1) & F.col("nhot_write").isNotNull()
    return (F.col("model") == "SCHISM") & (F.col("is_spinup") | F.coalesce(run_writes, F.lit(False)))


def _combines_output() -> Column:
    return (F.col("model") == "SCHISM") & ~F.col("is_spinup") & F.coalesce(F.col("old_io"), F.lit(False))


def job_manifest(runs: DataFrame) -> DataFrame:
    """One row per job of each run (columns of ``run_window`` and ``with_platform`` needed).

    ``processors`` is the model's own count; for coupled configurations ``total_processors`` is
    the sum over components, used by member runs.
    """
    own = F.col("processors").cast("bigint")
    coupled = F.coalesce(F.col("coupled"), F.lit(False)) & ~F.col("is_spinup")
    run_tasks = F.coalesce(F.when(coupled, F.col("total_processors").cast("bigint")).otherwise(own),
                           F.col("processors_per_node").cast("bigint"))
    model_tasks = F.coalesce(own, F.col("processors_per_node").cast("bigint"))

    def job(when: Column, job_type: str, tasks: Column) -> Column:
        return F.when(when, F.struct(F.lit(job_type).alias("job_type"), _named(job_type).alias("job_name"), tasks.alias("tasks")))

    jobs = F.filter(
        F.array(
            job(F.col("model") == "ADCIRC", "setup", F.lit(1).cast("bigint")),
            job(F.lit(True), "run", run_tasks),
            job(_combines_hotstart(), "combine_hotstart", model_tasks),
            job(_combines_output(), "combine_output", model_tasks),
        ),
        lambda j: j.isNotNull(),
    )
    seconds = F.coalesce(F.col("job_duration_s").cast("double"), F.lit(float(DEFAULT_JOB_SECONDS)))
    return runs.withColumn("_job", F.explode(jobs)).select(
        "config_dir",
        "run_name",
        "_job.job_name",
        "_job.job_type",
        "_job.tasks",
        node_count(F.col("_job.tasks"), F.col("processors_per_node")).alias("nodes"),
        seconds.alias("duration_s"),
        walltime(seconds).alias("walltime"),
        "account",
        "partition",
        F.concat("_job.job_name", F.lit(".err.log")).alias("err_log"),
        F.concat("_job.job_name", F.lit(".out.log")).alias("out_log"),
    )


def generation_jobs(configs: DataFrame) -> DataFrame:
    """The job that writes each configuration: one full node, the large-memory partition on Hera."""
    seconds = F.coalesce(F.col("job_duration_s").cast("double"), F.lit(float(DEFAULT_JOB_SECONDS)))
    name = F.lit("GENERATE_CONFIGURATION")
    return configs.select(
        "config_dir",
        F.lit(None).cast("string").alias("run_name"),
        name.alias("job_name"),
        F.lit("generate").alias("job_type"),
        F.col("processors_per_node").cast("bigint").alias("tasks"),
        F.lit(1).cast("bigint").alias("nodes"),
        seconds.alias("duration_s"),
        walltime(seconds).alias("walltime"),
        "account",
        F.when(F.col("platform") == "HERA", F.lit("bigmem")).otherwise(F.col("partition")).alias("partition"),
        F.lit(None).cast("string").alias("err_log"),
        F.lit("GENERATE_CONFIGURATION.log").alias("out_log"),
    )


def job_edges(runs: DataFrame) -> DataFrame:
    """``(config_dir, src_job, dst_job)``: jobs that wait for another, on platforms with a queue.

    Every edge follows from its run's own row, so nothing is joined.
    """
    adcirc, schism = F.col("model") == "ADCIRC", F.col("model") == "SCHISM"
    after_spinup = F.col("spinup_s").isNotNull() & ~F.col("is_spinup")

    def edge(when: Column, source: Column, target: Column) -> Column:
        return F.when(when, F.struct(source.alias("src_job"), target.alias("dst_job")))

    edges = F.filter(
        F.array(
            edge(adcirc, _named("setup"), _named("run")),
            edge(adcirc & after_spinup, F.lit("ADCIRC_COLDSTART_SPINUP"), _named("run")),
            edge(schism & after_spinup, F.lit("SCHISM_COMBINE_HOTSTARTFILES_SPINUP"), _named("run")),
            edge(_combines_hotstart(), _named("run"), _named("combine_hotstart")),
            edge(_combines_output(), _named("run"), _named("combine_output")),
        ),
        lambda e: e.isNotNull(),
    )
    return runs.where("uses_slurm").select("config_dir", F.explode(edges).alias("_e")).select("config_dir", "_e.*")


def spinup_steps(spinup_s: Column | str, timestep_s: Column | str) -> Column:
    """Steps of a spinup, which is also the step of its one restart file."""
    spinup_s = F.col(spinup_s) if isinstance(spinup_s, str) else spinup_s
    timestep_s = F.col(timestep_s) if isinstance(timestep_s, str) else timestep_s
    return F.rint(spinup_s / timestep_s).cast("bigint")


def step_plan(runs: DataFrame) -> DataFrame:
    """Restart steps and output stacks of SCHISM runs.

    Needs ``duration_s, timestep_s, ihfskip, nhot_write`` (steps; null ``ihfskip`` means the whole
    run and null ``nhot_write`` means ``ihfskip``). A restart is due every ``nhot_write`` steps.
    """
    steps = F.ceil(F.col("duration_s") / F.col("timestep_s")).cast("bigint")
    stack = F.coalesce(F.col("ihfskip").cast("bigint"), F.rint(F.col("duration_s") / F.col("timestep_s")).cast("bigint"))
    write = F.coalesce(F.col("nhot_write").cast("bigint"), stack)
    restarts = F.rint(F.col("duration_s") / (F.col("timestep_s") * write)).cast("int")
    return runs.select(
        "*",
        steps.alias("steps"),
        restarts.alias("restarts"),
        F.when(restarts > 0, F.transform(F.sequence(F.lit(1), F.greatest(restarts, F.lit(1))), lambda k: k * write))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("restart_steps"),
        F.ceil(steps / stack).cast("bigint").alias("output_stacks"),
    )


def hotstart_links(runs: DataFrame) -> DataFrame:
    """``(config_dir, run_name, source, target)``: restart files each hot start takes from its spinup.

    The SCHISM spinup itself links its combined restart file by step (``spinup_step``).
    """
    spinups = runs.where("is_spinup").select("config_dir", F.col("run_path").alias("_from"))
    hot = runs.where(~F.col("is_spinup")).join(spinups.hint("merge"), "config_dir")
    adcirc = F.col("model") == "ADCIRC"

    def link(source: str, target: str) -> Column:
        return F.struct(
            F.concat("_from", F.lit("/" + source)).alias("source"), F.concat("run_path", F.lit("/" + target)).alias("target")
        )

    pairs = F.when(adcirc, F.array(link("fort.67.nc", "fort.67.nc"), link("fort.68.nc", "fort.68.nc"))).otherwise(
        F.array(link("hotstart_out.nc", "hotstart.nc"))
    )
    from_spinup = hot.select("config_dir", "run_name", F.explode(pairs).alias("_l")).select("config_dir", "run_name", "_l.*")
    within = runs.where(F.col("is_spinup") & ~adcirc).select(
        "config_dir",
        "run_name",
        F.concat("run_path", F.lit("/outputs/hotstart_it="), F.col("spinup_step").cast("string"), F.lit(".nc")).alias("source"),
        F.concat("run_path", F.lit("/hotstart_out.nc")).alias("target"),
    )
    return from_spinup.unionByName(within)


def total_processors(components: DataFrame) -> DataFrame:
    return components.groupBy("config_dir").agg(F.sum("processors").cast("bigint").alias("total_processors"))


def processor_ranges(components: DataFrame) -> DataFrame:
    """Add the contiguous processor range ``[lo, hi]`` of each component in order of ``pos``."""
    # a configuration has a handful of components, so a plain window holds few rows
    upto = F.sum("processors").over(Window.partitionBy("config_dir").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return components.withColumn("_upto", upto).select(
        *components.columns,
        (F.col("_upto") - F.col("processors")).cast("bigint").alias("lo"),
        (F.col("_upto") - 1).cast("bigint").alias("hi"),
    )


def output_plan(configs: DataFrame) -> DataFrame:
    """Outputs each configuration writes, with interval and the run and spinup windows.

    Columns of ``configs`` carry the names of the model document's fields; times as ``start_ts``,
    ``end_ts``, durations in seconds.
    """
    spinup = F.col("tidal_spinup_duration").isNotNull() & F.col("output_spinup")

    def output(variable: str, flag: str, place: str, place_flag: str, interval: str) -> Column:
        return F.when(
            F.col(flag) & F.col(place_flag),
            F.struct(F.lit(variable).alias("variable"), F.lit(place).alias("place"), F.col(interval).alias("interval_s")),
        )

    rows = [
        output(variable, flag, place, f"output_{place}", f"{place}_output_interval")
        for variable, flag in (
            ("elevation", "output_elevations"),
            ("velocity", "output_velocities"),
            ("concentration", "output_concentrations"),
            ("meteorological", "output_meteorological_factors"),
        )
        for place in ("surface", "stations")
    ]
    wanted = F.filter(F.array(*rows), lambda o: o.isNotNull())
    return configs.withColumn("_o", F.explode(wanted)).select(
        "config_dir",
        "_o.variable",
        "_o.place",
        "_o.interval_s",
        "start_ts",
        "end_ts",
        F.when(spinup, F.col("surface_output_interval")).alias("spinup_interval_s"),
        F.when(spinup, shift_seconds(F.col("start_ts"), -F.col("tidal_spinup_duration"))).alias("spinup_start_ts"),
        F.when(spinup, F.col("start_ts")).alias("spinup_end_ts"),
    )


def pending_runs(runs: DataFrame, run_files: DataFrame) -> DataFrame:
    """Runs (``run_path, model, coupled, aswip``) whose written files are not all there.

    Files present are folded into one bit mask per run directory before the join.
    """
    names = [n for files in WRITTEN_FILES.values() for n in files] + WRITTEN_FILES_COUPLED + [WRITTEN_FILE_ASWIP]
    bits = {name: 1 << i for i, name in enumerate(names)}

    def mask(wanted: list[str]) -> int:
        return sum(bits[name] for name in wanted)

    bit = F.element_at(F.create_map(*[F.lit(v) for pair in bits.items() for v in pair]), F.col("rel_path"))
    present = (
        run_files.where(F.col("rel_path").isin(*names)).groupBy("run_path").agg(F.bit_or(bit).alias("_present"))
    )
    needed = reduce(
        lambda left, right: left.bitwiseOR(right),
        [
            F.when(F.col("model") == "ADCIRC", F.lit(mask(WRITTEN_FILES["ADCIRC"]))).otherwise(F.lit(mask(WRITTEN_FILES["SCHISM"]))),
            F.when(F.col("coupled"), F.lit(mask(WRITTEN_FILES_COUPLED))).otherwise(F.lit(0)),
            F.when(F.col("aswip") & (F.col("model") == "ADCIRC"), F.lit(mask([WRITTEN_FILE_ASWIP]))).otherwise(F.lit(0)),
        ],
    )
    return (
        runs.join(present.hint("merge"), "run_path", "left")
        .withColumn("_needed", needed)
        .where(F.coalesce(F.col("_present"), F.lit(0)).bitwiseAND(F.col("_needed")) != F.col("_needed"))
        .drop("_present", "_needed")
    )


def coupling_edges(configs: DataFrame, source: str = "connections") -> DataFrame:
    """``(config_dir, pos, src, dst)`` of connections or mediations.

    An entry is a list of names, or one text ``"A -> B"``; longer chains give an edge per step.
    """
    ends = F.filter(
        F.transform(F.flatten(F.transform("_entry", lambda text: F.split(text, "->"))), lambda name: F.trim(name)),
        lambda name: name != "",
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_ends") - 1, F.lit(1))),
        lambda i: F.struct(F.get("_ends", i - 1).alias("src"), F.get("_ends", i).alias("dst")),
    )
    return (
        configs.select("config_dir", F.posexplode(source).alias("pos", "_entry"))
        .select("config_dir", "pos", ends.alias("_ends"))
        .where(F.size("_ends") > 1)
        .select("config_dir", "pos", F.explode(steps).alias("_s"))
        .select("config_dir", "pos", "_s.*")
    )


def run_sequence(configs: DataFrame) -> DataFrame:
    """``(config_dir, pos, src, dst)`` of the run sequence; ``dst`` is null where a component runs alone."""
    parts = F.transform(F.split("_step", "->"), lambda name: F.trim(name))
    return configs.select("config_dir", F.posexplode("sequence").alias("pos", "_step")).select(
        "config_dir", "pos", F.get(parts, 0).alias("src"), F.get(parts, 1).alias("dst")
    )


def unknown_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Ends of edges that are no component of their configuration."""
    ends = edges.select("config_dir", F.explode(F.array("src", "dst")).alias("component")).where("component is not null")
    return ends.distinct().join(components.select("config_dir", "component"), ["config_dir", "component"], "left_anti")

"""Checks of run planning: windows, platforms, jobs, dependencies, processors, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import cycle_problems, submission_order
from ..operators.planning import (
    all_runs,
    coupling_edges,
    generation_jobs,
    hotstart_links,
    job_edges,
    job_manifest,
    output_plan,
    pending_runs,
    processor_ranges,
    rejected_configs,
    run_sequence,
    run_window,
    spinup_steps,
    step_plan,
    total_processors,
    unknown_components,
    with_platform,
)
from .registry import check, table

_PLATFORM_NAMES = ["HERA", "ORION", "STAMPEDE2", "LOCAL", "SLURM"]
_PLATFORM_SQL = """platforms AS (SELECT * FROM (VALUES
  ('HERA', 40, 'srun', true, 'coastal', NULL), ('ORION', 40, 'srun', true, 'nosofs', 'orion'),
  ('STAMPEDE2', 68, 'ibrun', true, 'coastal', 'development'), ('LOCAL', 1, NULL, false, NULL, NULL),
  ('SLURM', 36, 'srun', true, NULL, NULL)) t(platform, per_node, launcher, uses_slurm, def_account, def_partition))"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as configurations of either model on the five platforms, some coupled, some with a spinup."""
    names = F.array(*[F.lit(name) for name in _PLATFORM_NAMES])
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/c/"), k).alias("config_dir"),
        F.when(k % 2 == 0, "ADCIRC").otherwise("SCHISM").alias("model"),
        (k % 6 < 2).alias("coupled"),
        F.element_at(names, (F.col("c_nationkey") % 5 + 1)).alias("platform"),
        F.when(k % 3 == 0, F.lit("mine")).alias("account"),
        F.when(k % 4 != 0, (k % 10 + 1) * 3600.0).alias("spinup_s"),
        F.when(k % 5 != 0, F.lit(21600.0)).alias("job_duration_s"),
        (k % 100 + 1).alias("processors"),
        (k % 100 + 3).alias("total_processors"),
        (k % 7 == 1).alias("old_io"),
        F.lit(2.0).alias("timestep_s"),
        F.when(k % 11 != 3, F.lit(1)).otherwise(F.lit(0)).alias("nhot"),
        F.when(k % 13 != 5, F.lit(100)).alias("nhot_write"),
    )


_CONFIGS = """configs AS (SELECT '/c/' || c_custkey AS config_dir, CASE WHEN c_custkey % 2 = 0 THEN 'ADCIRC' ELSE 'SCHISM' END AS model,
  c_custkey % 6 < 2 AS coupled, ['HERA', 'ORION', 'STAMPEDE2', 'LOCAL', 'SLURM'][(c_nationkey % 5) + 1] AS platform,
  CASE WHEN c_custkey % 3 = 0 THEN 'mine' END AS account,
  CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 10 + 1) * 3600 END AS spinup_s,
  CASE WHEN c_custkey % 5 <> 0 THEN 21600 ELSE 3600 END AS job_s,
  c_custkey % 100 + 1 AS processors, c_custkey % 100 + 3 AS total_processors, c_custkey % 7 = 1 AS old_io,
  c_custkey % 11 <> 3 AND c_custkey % 13 <> 5 AS run_restart, c_custkey FROM customer)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/c/"), F.col("o_custkey")).alias("config_dir"),
        F.concat(F.lit("run_"), F.col("o_orderkey")).alias("run_name"),
        F.col("o_orderdate").alias("member_ts"),
    )


_RUNS = f"""{_PLATFORM_SQL}, {_CONFIGS},
plannable AS (SELECT * FROM configs WHERE NOT (model = 'SCHISM' AND coupled)),
runs AS (SELECT p.*, 'run_' || o_orderkey AS run_name, false AS is_spinup FROM plannable p JOIN orders ON config_dir = '/c/' || o_custkey
         UNION ALL SELECT *, 'spinup', true FROM plannable WHERE spinup_s IS NOT NULL),
placed AS (SELECT r.*, per_node, uses_slurm, coalesce(account, def_account) AS acct, def_partition AS part,
                  CASE WHEN is_spinup THEN 'SPINUP' ELSE run_name END AS label,
                  CASE WHEN spinup_s IS NOT NULL AND NOT is_spinup THEN 'HOTSTART' ELSE 'COLDSTART' END AS phase
           FROM runs r JOIN platforms USING (platform))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2008-08-23 00:00:00").cast("timestamp_ntz")
    configs = with_platform(_configs(spark, sf_dir)).withColumn("start_ts", start).withColumn("duration_s", F.lit(86400.0))
    place = F.when(F.col("is_spinup"), F.lit("spinup")).otherwise(F.concat(F.lit("runs/"), F.col("run_name")))
    runs = run_window(all_runs(configs, _members(spark, sf_dir)))
    return runs.select(
        "*",
        F.concat("config_dir", F.lit("/"), place).alias("run_path"),
        spinup_steps("spinup_s", "timestep_s").alias("spinup_step"),
    )


@check(
    f"""WITH {_RUNS}
SELECT config_dir, run_name, phase,
       strftime(CASE WHEN is_spinup THEN TIMESTAMP '2008-08-23' - to_seconds(spinup_s) ELSE TIMESTAMP '2008-08-23' END, '%Y-%m-%d %H:%M:%S') AS begins,
       CASE WHEN is_spinup THEN '2008-08-23 00:00:00' ELSE '2008-08-24 00:00:00' END AS ends FROM placed"""
)
def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda name: F.col(name).cast("string")
    return _runs(spark, sf_dir).select(
        "config_dir", "run_name", "phase", shown("begin_ts").alias("begins"), shown("finish_ts").alias("ends")
    )


_JOBS = f"""{_RUNS},
jobs AS (
  SELECT *, 'setup' AS job_type, 'ADCIRC_SETUP_' || label AS job_name, CAST(1 AS BIGINT) AS tasks FROM placed WHERE model = 'ADCIRC'
  UNION ALL SELECT *, 'run', model || '_' || phase || '_' || label,
                   CASE WHEN coupled AND NOT is_spinup THEN total_processors ELSE processors END FROM placed
  UNION ALL SELECT *, 'combine_hotstart', 'SCHISM_COMBINE_HOTSTARTFILES_' || label, processors FROM placed
            WHERE model = 'SCHISM' AND (is_spinup OR run_restart)
  UNION ALL SELECT *, 'combine_output', 'SCHISM_COMBINE_OUTPUTFILES_' || label, processors FROM placed
            WHERE model = 'SCHISM' AND NOT is_spinup AND old_io)"""


@check(
    f"""WITH {_JOBS}
SELECT config_dir, run_name, job_name, job_type, tasks, CAST(ceil(tasks / per_node) AS BIGINT) AS nodes,
       CAST(job_s AS DOUBLE) AS duration_s, CASE job_s WHEN 21600 THEN '06:00:00' ELSE '01:00:00' END AS walltime,
       acct AS account, part AS partition, job_name || '.err.log' AS err_log, job_name || '.out.log' AS out_log FROM jobs"""
)
def job_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_manifest(_runs(spark, sf_dir))


@check(
    f"""WITH {_JOBS}, queued AS (SELECT * FROM jobs WHERE uses_slurm),
starts AS (SELECT config_dir, run_name, job_name, is_spinup, model FROM queued WHERE job_type = 'run')
SELECT r.config_dir, q.job_name AS src_job, r.job_name AS dst_job FROM starts r JOIN queued q USING (config_dir, run_name) WHERE q.job_type = 'setup'
UNION ALL SELECT r.config_dir, r.job_name, q.job_name FROM starts r JOIN queued q USING (config_dir, run_name) WHERE q.job_type LIKE 'combine%'
UNION ALL SELECT r.config_dir, q.job_name, r.job_name FROM starts r JOIN queued q USING (config_dir)
          WHERE NOT r.is_spinup AND q.is_spinup AND q.job_type = CASE r.model WHEN 'ADCIRC' THEN 'run' ELSE 'combine_hotstart' END"""
)
def job_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_edges(_runs(spark, sf_dir))


@check(
    f"""WITH {_PLATFORM_SQL}, {_CONFIGS}
SELECT config_dir, 'GENERATE_CONFIGURATION' AS job_name, CAST(per_node AS BIGINT) AS tasks, CAST(1 AS BIGINT) AS nodes,
       coalesce(account, def_account) AS account, CASE platform WHEN 'HERA' THEN 'bigmem' ELSE def_partition END AS partition
FROM configs JOIN platforms USING (platform)"""
)
def generation_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = generation_jobs(with_platform(_configs(spark, sf_dir)))
    return jobs.select("config_dir", "job_name", "tasks", "nodes", "account", "partition")


@check(f"WITH {_CONFIGS} SELECT config_dir FROM configs WHERE model = 'SCHISM' AND coupled")
def rejected_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_configs(_configs(spark, sf_dir)).select("config_dir")


@check(
    f"""WITH {_RUNS},
hot AS (SELECT *, config_dir || '/runs/' || run_name AS here, config_dir || '/spinup' AS there FROM placed WHERE NOT is_spinup AND spinup_s IS NOT NULL)
SELECT config_dir, run_name, there || '/' || f AS source, here || '/' || f AS target FROM hot, (VALUES ('fort.67.nc'), ('fort.68.nc')) t(f) WHERE model = 'ADCIRC'
UNION ALL SELECT config_dir, run_name, there || '/hotstart_out.nc', here || '/hotstart.nc' FROM hot WHERE model = 'SCHISM'
UNION ALL SELECT config_dir, run_name, config_dir || '/spinup/outputs/hotstart_it=' || CAST(spinup_s // 2 AS BIGINT) || '.nc', config_dir || '/spinup/hotstart_out.nc'
          FROM placed WHERE is_spinup AND model = 'SCHISM'"""
)
def restart_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotstart_links(_runs(spark, sf_dir))


@check(
    f"""WITH {_PLATFORM_SQL},
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['HERA', 'ORION', 'STAMPEDE2', 'LOCAL', 'SLURM'][(l_suppkey % 5) + 1] AS platform,
             CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS BIGINT) * 7 END AS given FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, platform, coalesce(given, per_node) AS tasks, launcher,
       def_account AS account, def_partition AS partition, CAST(ceil(coalesce(given, per_node) / per_node) AS BIGINT) AS nodes
FROM l JOIN platforms USING (platform)"""
)
def platform_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.names import node_count

    names = F.array(*[F.lit(name) for name in _PLATFORM_NAMES])
    jobs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("platform"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("bigint") * 7).alias("tasks"),
    )
    return with_platform(jobs).withColumn("nodes", node_count("tasks", "processors_per_node")).drop(
        "processors_per_node", "uses_slurm"
    )


@check(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 50 + 1) * 600 AS dur, l_linenumber + 1 AS dt,
                  CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 20 + 50 END AS ihf, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 9 + 100 END AS nhw FROM lineitem),
f AS (SELECT *, CAST(ceil(dur / dt) AS BIGINT) AS steps, coalesce(ihf, CAST(round_even(dur / dt, 0) AS BIGINT)) AS stack FROM l),
g AS (SELECT *, coalesce(nhw, stack) AS w FROM f),
h AS (SELECT *, CAST(round_even(dur / (dt * w), 0) AS INTEGER) AS n FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, steps, n AS restarts, CAST(ceil(steps / stack) AS BIGINT) AS output_stacks,
       CASE WHEN n > 0 THEN w * n END AS last_restart, CAST(w * n * (n + 1) // 2 AS BIGINT) AS restart_sum FROM h"""
)
def step_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    runs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ((F.col("l_partkey") % 50 + 1) * 600.0).alias("duration_s"),
        (F.col("l_linenumber") + 1.0).alias("timestep_s"),
        F.when(s % 4 != 0, s % 20 + 50).alias("ihfskip"),
        F.when(s % 3 != 0, s % 9 + 100).alias("nhot_write"),
    )
    return step_plan(runs).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "steps", "restarts", "output_stacks",
        F.get("restart_steps", F.size("restart_steps") - 1).alias("last_restart"),
        F.aggregate("restart_steps", F.lit(0).cast("bigint"), lambda total, step: total + step).alias("restart_sum"),
    )


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("o"), F.col("l_orderkey")).alias("config_dir"), F.col("l_linenumber").alias("pos"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("processors"))
    )


_COMPONENTS = """components AS (SELECT 'o' || l_orderkey AS config_dir, l_linenumber AS pos, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS processors
  FROM lineitem GROUP BY ALL)"""


@check(
    f"""WITH {_COMPONENTS}, s AS (SELECT *, sum(processors) OVER (PARTITION BY config_dir ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM components)
SELECT config_dir, pos, processors, CAST(upto - processors AS BIGINT) AS lo, CAST(upto - 1 AS BIGINT) AS hi FROM s"""
)
def component_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processor_ranges(_components(spark, sf_dir))


@check(f"WITH {_COMPONENTS} SELECT config_dir, CAST(sum(processors) AS BIGINT) AS total_processors FROM components GROUP BY 1")
def processor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_processors(_components(spark, sf_dir))


@check(
    """WITH p AS (SELECT 'p' || p_partkey AS config_dir, p_partkey AS k, p_size FROM part),
o AS (SELECT *, unnest(['elevation', 'velocity', 'concentration', 'meteorological']) AS variable,
             unnest([k % 2 = 0, k % 3 = 0, k % 5 = 0, k % 7 = 0]) AS on_variable FROM p),
r AS (SELECT *, unnest(['surface', 'stations']) AS place, unnest([k % 11 <> 0, k % 4 = 0]) AS on_place,
             unnest([3600.0::DOUBLE, p_size * 60.0::DOUBLE]) AS interval_s FROM o)
SELECT config_dir, variable, place, interval_s, '2008-08-23 00:00:00' AS starts, '2008-09-06 12:00:00' AS ends,
       CASE WHEN k % 6 <> 0 AND k % 9 <> 0 THEN 3600.0::DOUBLE END AS spinup_interval_s,
       CASE WHEN k % 6 <> 0 AND k % 9 <> 0 THEN strftime(TIMESTAMP '2008-08-23' - to_hours(CAST(p_size AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS spinup_starts
FROM r WHERE on_variable AND on_place"""
)
def output_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    configs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k).alias("config_dir"),
        F.lit("2008-08-23 00:00:00").cast("timestamp_ntz").alias("start_ts"),
        F.lit("2008-09-06 12:00:00").cast("timestamp_ntz").alias("end_ts"),
        F.when(k % 6 != 0, F.col("p_size") * 3600.0).alias("tidal_spinup_duration"),
        (k % 9 != 0).alias("output_spinup"),
        (k % 2 == 0).alias("output_elevations"), (k % 3 == 0).alias("output_velocities"),
        (k % 5 == 0).alias("output_concentrations"), (k % 7 == 0).alias("output_meteorological_factors"),
        (k % 11 != 0).alias("output_surface"), (k % 4 == 0).alias("output_stations"),
        F.lit(3600.0).alias("surface_output_interval"), (F.col("p_size") * 60.0).alias("stations_output_interval"),
    )
    shown = lambda name: F.col(name).cast("string")
    return output_plan(configs).select(
        "config_dir", "variable", "place", "interval_s", shown("start_ts").alias("starts"), shown("end_ts").alias("ends"),
        "spinup_interval_s", shown("spinup_start_ts").alias("spinup_starts"),
    )


_WRITTEN = [
    "fort.13", "fort.14", "fort.15", "setup.job", "adcirc.job", "bctides.in", "hgrid.gr3", "hgrid.ll", "manning.gr3",
    "outputs", "param.nml", "vgrid.in", "schism.job", "nems.configure", "atm_namelist.rc", "model_configure", "config.rc", "fort.22",
]


@check(
    f"""WITH runs AS (SELECT '/r/' || p_partkey AS run_path, CASE WHEN p_partkey % 2 = 0 THEN 'ADCIRC' ELSE 'SCHISM' END AS model,
                    p_partkey % 5 = 0 AS coupled, p_partkey % 3 = 0 AS aswip FROM part),
files AS (SELECT DISTINCT '/r/' || l_partkey AS run_path, {_WRITTEN}[(l_orderkey % 18) + 1] AS f FROM lineitem),
needed AS (SELECT run_path, unnest(list_concat(list_concat(
    CASE model WHEN 'ADCIRC' THEN {_WRITTEN[:5]} ELSE {_WRITTEN[5:13]} END,
    CASE WHEN coupled THEN {_WRITTEN[13:17]} ELSE [] END), CASE WHEN aswip AND model = 'ADCIRC' THEN ['fort.22'] ELSE [] END)) AS f FROM runs)
SELECT * FROM runs WHERE run_path IN (SELECT run_path FROM needed n WHERE NOT EXISTS
  (SELECT 1 FROM files x WHERE x.run_path = n.run_path AND x.f = n.f))"""
)
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    runs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("/r/"), k).alias("run_path"),
        F.when(k % 2 == 0, "ADCIRC").otherwise("SCHISM").alias("model"),
        (k % 5 == 0).alias("coupled"),
        (k % 3 == 0).alias("aswip"),
    )
    names = F.array(*[F.lit(name) for name in _WRITTEN])
    files = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/r/"), F.col("l_partkey")).alias("run_path"),
        F.element_at(names, (F.col("l_orderkey") % 18 + 1).cast("int")).alias("rel_path"),
    )
    return pending_runs(runs, files)


def _couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as coupled configurations, connections given as pairs, texts and chains."""
    k = F.col("c_custkey")
    nation, segment = F.concat(F.lit("N"), F.col("c_nationkey")), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k).alias("config_dir"),
        F.array(
            F.array(nation, segment),
            F.array(F.concat(segment, F.lit(" -> OCN"))),
            F.array(F.concat(nation, F.lit(" -> MED -> "), segment)),
        ).alias("connections"),
        F.array(F.concat(nation, F.lit(" -> "), segment), nation, F.lit("OCN")).alias("sequence"),
        F.array_compact(F.array(nation, segment, F.when(k % 2 == 0, F.lit("OCN")))).alias("names"),
    )


_EDGES = """c AS (SELECT 'c' || c_custkey AS config_dir, c_custkey, 'N' || c_nationkey AS n, c_mktsegment AS s FROM customer),
edges AS (SELECT config_dir, c_custkey, n, s, unnest([0, 1, 2, 2]) AS pos, unnest([n, s, n, 'MED']) AS src, unnest([s, 'OCN', 'MED', s]) AS dst FROM c)"""


@check(f"WITH {_EDGES} SELECT config_dir, pos, src, dst FROM edges")
def coupling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling_edges(_couplings(spark, sf_dir))


@check(f"WITH {_EDGES} SELECT config_dir, unnest([0, 1, 2]) AS pos, unnest([n, n, 'OCN']) AS src, unnest([s, NULL, NULL]) AS dst FROM c")
def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sequence(_couplings(spark, sf_dir))


@check(
    f"""WITH {_EDGES} SELECT config_dir, 'MED' AS component FROM c
UNION ALL SELECT config_dir, 'OCN' FROM c WHERE c_custkey % 2 <> 0"""
)
def unknown_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = _couplings(spark, sf_dir)
    components = configs.select("config_dir", F.explode("names").alias("component"))
    return unknown_components(coupling_edges(configs), components)


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of 20 configurations that wait for jobs of larger number; in each fifth configuration one waits for a later one too."""
    key, scope = F.col("o_orderkey"), F.col("o_custkey") % 20
    name = lambda n: F.concat(F.lit("job_"), n)
    edges = table(spark, sf_dir, "orders").select(scope.alias("config"), name(key % 8).alias("src"), name(key % 8 + 1 + key % 3).alias("dst"))
    back = edges.select("config").distinct().where("config % 5 = 0").select("config", F.lit("job_6").alias("src"), F.lit("job_2").alias("dst"))
    return edges.unionByName(back)


_WAITS = """RECURSIVE edges AS (SELECT DISTINCT o_custkey % 20 AS config, 'job_' || o_orderkey % 8 AS src, 'job_' || (o_orderkey % 8 + 1 + o_orderkey % 3) AS dst FROM orders
                    UNION SELECT DISTINCT o_custkey % 20, 'job_6', 'job_2' FROM orders WHERE o_custkey % 5 = 0),
  names AS (SELECT config, src AS name FROM edges UNION SELECT config, dst FROM edges),
  ways AS (SELECT config, name, 0 AS level FROM names UNION SELECT w.config, dst, level + 1 FROM ways w JOIN edges e ON w.config = e.config AND w.name = src WHERE level < 20),
  ways_back AS (SELECT config, name, 0 AS level FROM names UNION SELECT w.config, src, level + 1 FROM ways_back w JOIN edges e ON w.config = e.config AND w.name = dst WHERE level < 20),
  levels AS (SELECT config, name, CASE WHEN max(level) < 20 THEN max(level) END AS level FROM ways GROUP BY ALL)"""


@check(
    f"""WITH {_WAITS} SELECT config, name, level::INTEGER AS level,
       CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY config ORDER BY level NULLS LAST, name) END AS place FROM levels"""
)
def submission_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and place of every job; jobs that wait for a cycle have neither."""
    return submission_order(_waits(spark, sf_dir), "config", "src", "dst")


@check(
    f"""WITH {_WAITS}, stuck AS (SELECT config, name FROM ways WHERE level = 20 INTERSECT SELECT config, name FROM ways_back WHERE level = 20)
    SELECT e.* FROM edges e JOIN stuck a ON e.config = a.config AND src = a.name JOIN stuck b ON e.config = b.config AND dst = b.name"""
)
def submission_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_problems(_waits(spark, sf_dir), "config", "src", "dst")

"""Canonical inputs derived from the driver's tables inside Spark, and the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


# Log lines of ADCIRC runs: events spread over out-logs, an err-log and ESMF logs.
FLEET_LINES = """
SELECT '/fleet/' || user_id || '_' || (event_id % 10) AS run_path,
       CASE (event_id // 10) % 6
            WHEN 4 THEN 'ADCIRC_HOTSTART_x.err.log'
            WHEN 5 THEN 'PET' || ((event_id // 60) % 2) || '.ESMF_LogFile'
            ELSE 'ADCIRC_HOTSTART_' || ((event_id // 60) % 2) || '.out.log' END AS file_name,
       event_id AS line_no,
       CASE (event_id // 10) % 6
            WHEN 4 THEN CASE WHEN event_type = 'error' THEN 'srun: error: task ' || CAST(floor(value) AS BIGINT) END
            WHEN 5 THEN CASE WHEN event_type = 'error' THEN 'ERROR ' || CAST(floor(value) AS BIGINT)
                             WHEN event_type IN ('signup', 'view') THEN 'INFO ' || CAST(floor(value) AS BIGINT) END
            ELSE CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Error ' || CAST(floor(value) AS BIGINT)
                      WHEN event_type = 'error' THEN 'srun: error: ' || CAST(floor(value) AS BIGINT)
                      WHEN event_type = 'purchase' THEN CAST(floor(value / 4) AS BIGINT) || '.5% COMPLETE'
                      WHEN event_type = 'signup' THEN 'End Epilogue'
                      ELSE 'step ' || CAST(floor(value) AS BIGINT) END END AS line,
       user_id, value
FROM events
"""


def fleet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = F.floor("value").cast("string")
    slot = F.floor(F.col("event_id") / 10) % 6
    copy = (F.floor(F.col("event_id") / 60) % 2).cast("string")
    kind = F.col("event_type")
    out = (
        F.when((kind == "error") & (F.col("event_id") % 3 == 0), F.concat(F.lit("Error "), n))
        .when(kind == "error", F.concat(F.lit("srun: error: "), n))
        .when(kind == "purchase", F.concat(F.floor(F.col("value") / 4).cast("string"), F.lit(".5% COMPLETE")))
        .when(kind == "signup", F.lit("End Epilogue"))
        .otherwise(F.concat(F.lit("step "), n))
    )
    esmf = F.when(kind == "error", F.concat(F.lit("ERROR "), n)).when(
        kind.isin("signup", "view"), F.concat(F.lit("INFO "), n)
    )
    err = F.when(kind == "error", F.concat(F.lit("srun: error: task "), n))
    return events.select(
        F.concat(F.lit("/fleet/"), F.col("user_id"), F.lit("_"), F.col("event_id") % 10).alias("run_path"),
        F.when(slot == 4, F.lit("ADCIRC_HOTSTART_x.err.log"))
        .when(slot == 5, F.concat(F.lit("PET"), copy, F.lit(".ESMF_LogFile")))
        .otherwise(F.concat(F.lit("ADCIRC_HOTSTART_"), copy, F.lit(".out.log")))
        .alias("file_name"),
        F.col("event_id").alias("line_no"),
        F.when(slot == 4, err).when(slot == 5, esmf).otherwise(out).alias("line"),
        "user_id",
        "value",
    )


# The listing that goes with those lines: logs with their sizes, markers, main output, one NetCDF file.
FLEET_FILES = """
SELECT run_path, file_name AS rel_path, CAST(coalesce(sum(length(line) + 1), 0) AS BIGINT) AS length
FROM fleet_lines GROUP BY ALL
UNION ALL
SELECT run_path, f.rel_path,
       CASE WHEN f.rel_path = 'fort.63.nc' THEN CAST(floor(max(value) * 500) AS BIGINT) ELSE CAST(1 AS BIGINT) END
FROM fleet_lines, (VALUES ('fort.14'), ('fort.15'), ('fort.16'), ('fort.63.nc')) f(rel_path)
WHERE NOT (f.rel_path = 'fort.15' AND user_id % 13 = 5) AND NOT (f.rel_path = 'fort.16' AND user_id % 7 = 3)
GROUP BY run_path, f.rel_path
"""


def fleet_files(lines: DataFrame) -> DataFrame:
    """``lines`` is ``fleet_lines``; one aggregation gives logs and the facts of each run's other files."""
    per_file = lines.groupBy("run_path", "user_id", F.col("file_name").alias("rel_path")).agg(
        F.coalesce(F.sum(F.length("line") + 1), F.lit(0)).cast("bigint").alias("length"),
        F.max("value").alias("value"),
    )
    per_run = per_file.groupBy("run_path", "user_id").agg(F.floor(F.max("value") * 500).cast("bigint").alias("bytes"))
    one = F.lit(1).cast("bigint")

    def entry(name: str, size, when):
        return F.when(when, F.struct(F.lit(name).alias("rel_path"), size.alias("length")))

    others = F.array_compact(
        F.array(
            entry("fort.14", one, F.lit(True)),
            entry("fort.15", one, F.col("user_id") % 13 != 5),
            entry("fort.16", one, F.col("user_id") % 7 != 3),
            entry("fort.63.nc", F.col("bytes"), F.lit(True)),
        )
    )
    extra = per_run.select("run_path", F.explode(others).alias("o")).select("run_path", "o.*")
    return per_file.select("run_path", "rel_path", "length").unionByName(extra)


def fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = fleet_lines(spark, sf_dir)
    return fleet_files(lines), lines.where("line is not null").select("run_path", "file_name", "line_no", "line")


FLEET_CTE = f"fleet_lines AS ({FLEET_LINES}), fleet_files AS ({FLEET_FILES})"


# Log lines of SCHISM runs, stepping log included.
SCHISM_LINES = """
SELECT '/fleet/' || user_id || '_' || (event_id % 10) AS run_path,
       CASE (event_id // 10) % 3 WHEN 0 THEN 'SCHISM_HOTSTART_x.out.log'
            ELSE 'outputs/mirror.out' END AS file_name,
       event_id AS line_no,
       CASE WHEN (event_id // 10) % 3 = 0
            THEN CASE WHEN event_type = 'signup' THEN 'End Epilogue' ELSE 'Error ' || CAST(floor(value) AS BIGINT) END
            WHEN event_type = 'purchase' THEN ' time stepping begins...   1   ' || (400 + CAST(floor(value) AS BIGINT))
            WHEN event_type IN ('view', 'click') THEN 'TIME STEP= ' || CAST(floor(value) AS BIGINT) || '; x'
            WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'Run completed successfully at t'
            ELSE 'it ' || CAST(floor(value) AS BIGINT) END AS line,
       user_id, value
FROM events
"""
SCHISM_FILES = """
SELECT run_path, file_name AS rel_path, CAST(sum(length(line) + 1) AS BIGINT) AS length
FROM schism_lines GROUP BY ALL
UNION ALL
SELECT run_path, f.rel_path,
       CASE WHEN f.rel_path = 'outputs/out2d_1.nc' THEN CAST(floor(max(value) * 500) AS BIGINT) ELSE CAST(1 AS BIGINT) END
FROM schism_lines, (VALUES ('hgrid.gr3'), ('vgrid.in'), ('param.nml'), ('outputs'), ('bctides.in'), ('outputs/out2d_1.nc')) f(rel_path)
WHERE NOT (f.rel_path = 'bctides.in' AND user_id % 13 = 5)
GROUP BY run_path, f.rel_path
"""
SCHISM_CTE = f"schism_lines AS ({SCHISM_LINES}), schism_files AS ({SCHISM_FILES})"


def schism_fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    n = F.floor("value").cast("bigint")
    kind = F.col("event_type")
    in_log = F.floor(F.col("event_id") / 10) % 3 == 0
    line = (
        F.when(in_log & (kind == "signup"), F.lit("End Epilogue"))
        .when(in_log, F.concat(F.lit("Error "), n))
        .when(kind == "purchase", F.concat(F.lit(" time stepping begins...   1   "), n + 400))
        .when(kind.isin("view", "click"), F.concat(F.lit("TIME STEP= "), n, F.lit("; x")))
        .when((kind == "error") & (F.col("event_id") % 7 == 0), F.lit("Run completed successfully at t"))
        .otherwise(F.concat(F.lit("it "), n))
    )
    lines = events.select(
        F.concat(F.lit("/fleet/"), F.col("user_id"), F.lit("_"), F.col("event_id") % 10).alias("run_path"),
        F.when(in_log, F.lit("SCHISM_HOTSTART_x.out.log")).otherwise(F.lit("outputs/mirror.out")).alias("file_name"),
        F.col("event_id").alias("line_no"),
        line.alias("line"),
        "user_id",
        "value",
    )
    per_file = lines.groupBy("run_path", "user_id", F.col("file_name").alias("rel_path")).agg(
        F.sum(F.length("line") + 1).cast("bigint").alias("length"), F.max("value").alias("value")
    )
    per_run = per_file.groupBy("run_path", "user_id").agg(F.floor(F.max("value") * 500).cast("bigint").alias("bytes"))
    one = F.lit(1).cast("bigint")
    names = ["hgrid.gr3", "vgrid.in", "param.nml", "outputs", "bctides.in", "outputs/out2d_1.nc"]
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("user_id") % 13 != 5 if name == "bctides.in" else F.lit(True),
                    F.struct(F.lit(name).alias("rel_path"), (F.col("bytes") if name.endswith("nc") else one).alias("length")),
                )
                for name in names
            ]
        )
    )
    extra = per_run.select("run_path", F.explode(entries).alias("o")).select("run_path", "o.*")
    return (
        per_file.select("run_path", "rel_path", "length").unionByName(extra),
        lines.select("run_path", "file_name", "line_no", "line"),
    )

"""Run state kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logs import LOG_GLOB, classify_lines, round_percent
from ..functions.paths import base_name, parent_path, path_in_run, plain_path, run_of_file


def stream_log_lines(spark: SparkSession, root: str, glob: str = LOG_GLOB, max_files: int | None = None) -> DataFrame:
    """Lines of logs as they arrive. Each file is read once, so logs must be rotated or added as new files."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(root)
    path = plain_path(F.col("_metadata.file_path"))
    return lines.select(
        run_of_file(parent_path(path)).alias("run_path"),
        path_in_run(parent_path(path), base_name(path)).alias("file_name"),
        F.col("value").alias("line"),
    )


def stream_run_status(log_lines: DataFrame) -> DataFrame:
    """Per run: ``model, progress, ended, has_error, status`` as far as its lines tell.

    Lines carry no event time and arrive in any order, so only order-free aggregates are kept, updated in place; use output mode
    ``update``, which gives the runs of a batch that changed, and merge by run (``latest_states``). The state of a run is
    a few numbers and the names of its out-logs, those seen and those that ended: as many as it has jobs. A run is completed when every
    out-log has its end mark, as in the batch report; progress is the largest percentage of the first out-log by name that has one, or the
    share of steps. What only a listing tells (missing or small outputs) is left to the batch report.
    """
    lines = classify_lines(log_lines)
    out_log = F.col("role").isin("adcirc_out", "schism_out")
    percent = F.when(F.col("percent") != 0, F.struct("file_name", (-F.col("percent")).alias("left")))
    state = lines.groupBy("run_path").agg(
        F.collect_set(F.when(out_log, F.col("file_name"))).alias("_seen"),
        F.collect_set(F.when(F.col("is_end"), F.col("file_name"))).alias("_ended"),
        F.min(percent).alias("_percent"),
        F.max("step").alias("_step"),
        F.max("total_steps").alias("_total"),
        F.bool_or("is_finished").alias("_finished"),
        F.bool_or(F.startswith(F.col("role"), F.lit("schism"))).alias("_schism"),
        F.bool_or(F.col("is_error") | F.col("role").isin("adcirc_err", "schism_err")).alias("has_error"),
    )
    share = round_percent(F.try_divide((F.lit(100) * F.col("_step")).cast("double"), F.col("_total").cast("double")))
    stepped = F.when(F.coalesce("_finished", F.lit(False)), F.lit(100.0)).otherwise(share)
    schism = F.coalesce("_schism", F.lit(False))
    ended = (F.size("_seen") > 0) & (F.size(F.array_except("_seen", "_ended")) == 0)
    has_error = F.coalesce("has_error", F.lit(False))
    return state.select(
        "run_path",
        F.when(schism, F.lit("SCHISM")).otherwise(F.lit("ADCIRC")).alias("model"),
        F.coalesce(F.when(schism, stepped).otherwise(-F.col("_percent.left")), F.lit(0.0)).alias("progress"),
        ended.alias("ended"),
        has_error.alias("has_error"),
        F.when(F.size("_seen") == 0, "not_started").when(has_error, "error").when(ended, "completed").otherwise("running").alias("status"),
    )


#: Batches of states after which they are folded into one table.
COMPACT_EVERY = 16


def write_states(states: DataFrame, folder: str, compact_every: int = COMPACT_EVERY):
    """A started-on-demand writer of run states: each batch's changed runs go to a folder of their own below ``folder``.

    Every ``compact_every`` batches the last state of each run is written as one table and the batches in it are dropped, so what is
    kept and read grows with the number of runs, not with the time. A batch that is repeated writes the same again.
    """
    if compact_every < 1:
        raise ValueError("compact_every must be 1 at least")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")
        if (number + 1) % compact_every == 0:
            _compact(batch.sparkSession, folder, number)

    return states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").foreachBatch(keep)


def _kept(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """Number of the newest complete table (-1 without any) and of the batches after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/states")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return -1, []
    done = [s.getPath() for s in system.listStatus(path) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    named = [p.getName().split("=") for p in done]
    upto = max((int(n) for kind, n in named if kind == "upto"), default=-1)
    return upto, sorted(int(n) for kind, n in named if kind == "batch" and int(n) > upto)


def _compact(spark: SparkSession, folder: str, number: int) -> None:
    upto, batches = _kept(spark, folder)
    if number <= upto:
        return
    latest_states(spark, folder).write.mode("overwrite").parquet(f"{folder}/states/upto={number}")
    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"batch={n}" for n in batches if n <= number] + ([f"upto={upto}"] if upto >= 0 else []):
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/states/{name}"), True)


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state written of every run; runs that have expired are left out."""
    upto, batches = _kept(spark, folder)
    parts = [spark.read.parquet(f"{folder}/states/batch={n}").withColumn("batch", F.lit(n)) for n in batches]
    if upto >= 0:
        parts.append(spark.read.parquet(f"{folder}/states/upto={upto}").withColumn("batch", F.lit(upto)))
    if not parts:
        raise FileNotFoundError(f"no states in {folder}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    kept = [c for c in rows.columns if c not in ("run_path", "batch")]
    last = rows.groupBy("run_path").agg(F.max_by(F.struct(*kept), F.col("batch")).alias("_s")).select("run_path", "_s.*")
    return last.where(~F.coalesce("expired", F.lit(False))).drop("expired") if "expired" in kept else last

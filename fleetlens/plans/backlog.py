"""Which runs still have to be submitted?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.status import outermost_runs, run_status, unqueued_runs
from ..sources.run_files import scan_run_files
from ..sources.text import listed_log_lines, scan_job_queue


def backlog(spark: SparkSession, roots: list[str], queue_path: str, match: str = "name") -> DataFrame:
    """Runs below ``roots`` that are neither in the queue snapshot nor started."""
    files = scan_run_files(spark, roots)
    status = run_status(files, listed_log_lines(files))
    runs = outermost_runs(status.select("run_path", "run_name"))
    return unqueued_runs(runs, scan_job_queue(spark, queue_path), status, match)

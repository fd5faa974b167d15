"""Text sources: logs, configuration documents and the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import LOG_GLOB
from ..functions.paths import base_name, parent_path, path_in_run, plain_path, run_of_file
from ..operators.config import kind_of_file
from ..operators.ordered import last_wins
from .ranges import SPAN, listed_path, read_lines, read_texts
from .run_files import glob_pattern, scan_run_files

_ROW_BITS = 33


def _placed_lines(reader, paths: list[str] | str) -> DataFrame:
    lines = reader.text(paths)
    return lines.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def _order_key() -> Column:
    """A number that grows with the line's place in its file, made without moving any line.

    A line takes a byte at least, so a split that starts at byte s and ends before byte t has fewer than 2 (t - s) lines, and twice the
    start plus the line's place in its partition (all 33 bits of it) grows from split to split. Only a file's last split shares
    its partition with others before it: the reader fills a partition with a split of full size.
    """
    row = F.col("row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return F.col("block") * 2 + row


def scan_log_lines(spark: SparkSession, roots: list[str] | str, glob: str = LOG_GLOB) -> DataFrame:
    """Log lines below ``roots`` with the run they belong to and their order in the file (see ``listed_log_lines``)."""
    return listed_log_lines(scan_run_files(spark, [roots] if isinstance(roots, str) else roots), glob)


def listed_log_lines(run_files: DataFrame, glob: str = LOG_GLOB, span: int = SPAN) -> DataFrame:
    """Log lines of the files of a listing, read by byte ranges.

    ``file_name`` is the path inside the run directory. ``line_no`` grows with the line (it is the place of its first byte) but is no
    count; ``number_lines`` gives counts at the price of a shuffle. A file listed under several roots is read once.
    """
    logs = _listed(run_files, glob)
    lines = read_lines(logs, span)
    directory = parent_path("path")
    return lines.select(
        run_of_file(directory).alias("run_path"),
        path_in_run(directory, base_name("path")).alias("file_name"),
        F.col("at").alias("line_no"),
        "line",
    )


def _listed(run_files: DataFrame, glob: str) -> DataFrame:
    """``path, length`` of the listed files whose name is like the glob, each once."""
    patterns = [glob_pattern(one) for one in glob.strip("{}").split(",")]
    named = F.col("file_name").rlike("|".join(patterns))
    return run_files.where(~F.col("is_dir") & named).groupBy(listed_path().alias("path")).agg(F.max("length").alias("length"))


def scan_tree_lines(spark: SparkSession, root: str) -> DataFrame:
    """``(rel_path, line_no, line)`` of every text file below ``root``, with line counts from 1."""
    lines = number_lines(_placed_lines(spark.read.option("recursiveFileLookup", True), root))
    start = len(root.rstrip("/")) + 2
    return lines.select(F.substr("path", F.lit(start)).alias("rel_path"), "line_no", "line")


def number_lines(placed: DataFrame) -> DataFrame:
    """``(path, line_no, line)``: line counts from 1 in files of any number of blocks, without moving the lines.

    Rows of a block lie together in one partition, so their ids are consecutive. One small row per block holds its first id and the
    number of lines in the blocks before it.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        placed.groupBy("path", "block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
        .select("path", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    return placed.join(blocks, ["path", "block"]).select("path", (F.col("row") + F.col("_shift")).alias("line_no"), "line")


def number_text_lines(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(*key, line_no, line)`` of whole texts held in one column; numbered inside each row."""
    return texts.select(*key, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("_p", "line")).select(
        *key, (F.col("_p") + 1).cast("bigint").alias("line_no"), "line"
    )


def scan_config_docs(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    """Configuration documents below ``roots``, one row each; ``parse_documents`` flags malformed ones."""
    return listed_config_docs(scan_run_files(spark, [roots] if isinstance(roots, str) else roots))


def listed_config_docs(run_files: DataFrame) -> DataFrame:
    """Configuration documents among the files of a listing."""
    docs = read_texts(_listed(run_files, "configure_*.json"))
    return docs.select(
        parent_path("path").alias("config_dir"),
        kind_of_file(base_name("path")).alias("kind"),
        base_name("path").alias("file_name"),
        "raw",
    )


def scan_job_queue(spark: SparkSession, path: str) -> DataFrame:
    """``(job_name, workdir, job_id, line_no)`` of a queue snapshot with a header line: every row, names may repeat."""
    return parse_job_queue(_placed_lines(spark.read, path).withColumn("line_no", _order_key()))


def parse_job_queue(lines: DataFrame) -> DataFrame:
    """Rows of queue snapshots given as ``(path, line_no, line)``; the first line of each is its header.

    A snapshot may hold most of all lines, so its lines are dealt over many tasks, and its header goes to each of them.
    """
    slices = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    header = lines.groupBy("path").agg(F.min("line_no").alias("_header")).select("path", "_header", every.alias("_slice"))
    words = F.split(F.trim("line"), r"\s+")
    return (
        lines.withColumn("_slice", F.pmod(F.xxhash64("line_no"), F.lit(slices)).cast("int"))
        .join(header, ["path", "_slice"])
        .where((F.col("line_no") > F.col("_header")) & (F.size(words) >= 2))
        .select(
            F.get(words, 0).alias("job_name"), F.get(words, 1).alias("workdir"), F.get(words, 2).alias("job_id"), "line_no"
        )
    )


def latest_jobs(queue: DataFrame) -> DataFrame:
    """One row per job name, the last of the snapshot."""
    return last_wins(queue, ["job_name"], "line_no")

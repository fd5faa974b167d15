"""Columns that read meaning out of file names, log lines and status fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durations import parse_number

# Patterns of the lines and files that carry run state.
ERROR_PREFIX = r"^(?i)error"
PERCENT_DONE = r"([0-9.]+)% COMPLETE"
END_MARK = "End Epilogue"
STEPPING_BEGINS = r"^\stime stepping begins\.\.\.\s+\d+\s+(\d+).*$"
STEP_REACHED = r"^TIME STEP=\s+(\d+);.*$"
FINISHED = r"^Run completed successfully.*$"
ROLE_PATTERNS = {
    "adcirc_out": r"^ADCIRC_[^/]*_[^/]*\.out\.log$",
    "adcirc_err": r"^ADCIRC_[^/]*_[^/]*\.err\.log$",
    "schism_out": r"^SCHISM_[^/]*_[^/]*\.out\.log$",
    "schism_err": r"^SCHISM_[^/]*_[^/]*\.err\.log$",
    "esmf": r"^PET[^/]*\.ESMF_LogFile$",
    "adcirc_nc": r"^fort\.[^/]*\.nc$",
    "schism_nc": r"^outputs/(schout[^/]*|out2d_1)\.nc$",
    "adcirc_output": r"^fort\.16$",
    "schism_output": r"^outputs/mirror\.out$",
}
LOG_GLOB = "{ADCIRC_*_*.out.log,ADCIRC_*_*.err.log,SCHISM_*_*.out.log,SCHISM_*_*.err.log,PET*.ESMF_LogFile,mirror.out}"


def file_role(rel_path: str) -> Column:
    """What a file (column with its path inside the run directory) tells about the run; null for other files."""
    cases = " ".join(f"WHEN {rel_path} RLIKE r'{pattern}' THEN '{name}'" for name, pattern in ROLE_PATTERNS.items())
    return F.expr(f"CASE {cases} END")


def is_error(line: Column | str, anywhere: bool = False) -> Column:
    """Line starts with ``error`` in any case, or holds it when ``anywhere``."""
    line = F.col(line) if isinstance(line, str) else line
    return line.rlike(r"(?i)error" if anywhere else ERROR_PREFIX)


def percent_done(line: Column | str) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    number = F.regexp_extract(line, PERCENT_DONE, 1)
    return F.when(line.contains("% COMPLETE"), parse_number(number))


def classify_lines(log_lines: DataFrame, anywhere: bool = False) -> DataFrame:
    """Add the flags and values of each line in one pass; values of another role's lines stay null."""
    line, role = F.col("line"), F.col("role")
    out_log = role.isin("adcirc_out", "schism_out")
    stepping = role == "schism_output"
    # the role is a column of its own first, so its patterns are matched once per line
    return log_lines.withColumn("role", file_role("file_name")).select(
        *log_lines.columns,
        "role",
        F.when(role.isin("adcirc_out", "esmf"), is_error(line, anywhere)).otherwise(F.lit(False)).alias("is_error"),
        F.when(role == "adcirc_out", percent_done(line)).alias("percent"),
        F.when(out_log, line.contains(END_MARK)).otherwise(F.lit(False)).alias("is_end"),
        F.when(stepping, F.regexp_extract(line, STEPPING_BEGINS, 1).try_cast("bigint")).alias("total_steps"),
        F.when(stepping, F.regexp_extract(line, STEP_REACHED, 1).try_cast("bigint")).alias("step"),
        F.when(stepping, line.rlike(FINISHED)).otherwise(F.lit(False)).alias("is_finished"),
    )


def round_percent(value: Column) -> Column:
    """Two decimals, half to even on the exact binary value.

    Spark's ``round`` works on the printed decimals, where 2.675 is a tie; its binary value lies
    below. The fraction is scaled by 2^62, which loses no bit that matters, and compared to the
    midpoint of its two candidates in exact decimals.
    """
    whole = F.floor(value)
    fraction = ((value - whole) * float(1 << 62)).cast("bigint").cast("decimal(20,0)")
    below = F.floor(value * 100)
    midpoint = (below * 2 + 1 - whole * 200).cast("decimal(5,0)")
    above_midpoint = fraction * F.lit(200).cast("decimal(3,0)") - midpoint * F.lit(1 << 62).cast("decimal(20,0)")
    up = (above_midpoint > 0) | ((above_midpoint == 0) & (below % 2 != 0))
    return (below + F.when(up, 1).otherwise(0)) / F.lit(100.0)


def status_text(status: Column | str = "status", progress: Column | str = "progress_text") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    progress = F.col(progress) if isinstance(progress, str) else progress
    return F.concat(F.lower(status), F.lit(" - "), progress, F.lit("%"))


def run_number(name: Column | str) -> Column:
    """Decimal suffix after the last ``_``, else -1."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(parse_number(F.regexp_extract(name, r"_(\d+)$", 1)), F.lit(-1.0))

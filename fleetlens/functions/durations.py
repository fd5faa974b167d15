"""Durations, wall-clock strings and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# checked before any cast: a failed cast to double costs an exception inside the JVM
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
_DURATION = r"^[-+]?[0-9.eE+-]+(:[0-9.]+){0,3}$"
# seconds per part, from the last part of a colon-separated duration to the first
_PART_SECONDS = [1.0, 60.0, 3600.0, 86400.0]


def parse_number(text: Column) -> Column:
    """Double of a plain decimal number; null for anything else."""
    text = F.trim(text)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_duration(col: Column | str) -> Column:
    """Seconds in ``"150"``, ``MM:SS``, ``HH:MM:SS`` or ``D:HH:MM:SS``; null when malformed."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.trim(col)
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    seconds = F.lit(0.0)
    for back, weight in enumerate(_PART_SECONDS):
        part = F.substring_index(F.substring_index(text, ":", -(back + 1)), ":", 1)
        seconds = seconds + F.when(colons >= back, part.try_cast("double") * weight).otherwise(0.0)
    return F.when(text.rlike(_DURATION), seconds)


def walltime(seconds: Column | str) -> Column:
    """``HH:MM:SS`` of a number of seconds; hours may go over 24."""
    seconds = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("double")
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds - hours * 3600) / 60)
    rest = F.rint(seconds - hours * 3600 - minutes * 60).cast("bigint")
    shown = F.concat(_two_digits(hours), F.lit(":"), _two_digits(minutes), F.lit(":"), _two_digits(rest))
    return F.when(seconds >= 0, shown)


def _two_digits(number: Column) -> Column:
    return F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))


def parse_datetime(col: Column | str) -> Column:
    """Zone-less timestamp of ``yyyyMMdd``, ``yyyyMMddHH`` or an ISO date or date-time; null otherwise."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    compact = F.regexp_replace(compact, r"^(\d{4})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:00:00")
    return compact.try_cast("timestamp_ntz")


def shift_seconds(ts: Column, seconds: Column) -> Column:
    """``ts`` moved by a number of seconds (fractions kept)."""
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one zone-less timestamp to another, whatever the session's time zone."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")

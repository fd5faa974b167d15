"""Names of jobs, storms, enum values and tidal constituents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_enum(col: Column | str, allowed: list[str]) -> Column:
    """Upper-cased name when it is one of ``allowed``, else null."""
    name = F.upper(F.trim(_col(col)))
    return F.when(name.isin(*[value.upper() for value in allowed]), name)


def job_name(model: Column, job_type: Column, phase: Column, run_name: Column) -> Column:
    """``<MODEL>_<SETUP|phase|COMBINE_...>_<run>``."""
    middle = F.when(job_type == "run", phase).when(job_type == "setup", F.lit("SETUP")).otherwise(
        F.when(job_type == "combine_hotstart", F.lit("COMBINE_HOTSTARTFILES")).otherwise(F.lit("COMBINE_OUTPUTFILES"))
    )
    return F.concat_ws("_", model, middle, run_name)


def node_count(tasks: Column | str, processors_per_node: Column | str) -> Column:
    return F.ceil(_col(tasks) / _col(processors_per_node)).cast("bigint")


def storm_code(basin: Column, number: Column, start_year: Column) -> Column:
    return F.concat(basin, F.lpad(number.cast("string"), 2, "0"), start_year.cast("string"))


def capitalize(name: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2), F.length(name))))


def constituent_group(names: Column | str, groups: dict[str, list[str]]) -> Column:
    """Name of the first group that holds exactly the given constituents, else null."""
    given = F.array_sort(F.transform(_col(names), capitalize))
    label = F.lit(None).cast("string")
    for group, members in reversed(list(groups.items())):
        wanted = F.array(*[F.lit(m) for m in sorted(m.capitalize() for m in members)])
        label = F.when(given == wanted, F.lit(group)).otherwise(label)
    return label


def normalize_constituents(names: Column | str, groups: dict[str, list[str]]) -> Column:
    """Active constituents: ``All`` or ``Major`` (also when spelled out) stand for their members.

    ``groups`` maps ``All`` and ``Major`` to their constituents in the order of the tidal source.
    """
    given = F.transform(_col(names), capitalize)
    group = constituent_group(names, groups)
    given = F.when(group.isNotNull(), F.array(group)).otherwise(given)
    every = F.array(*[F.lit(m) for m in groups["All"]])
    major = F.array(*[F.lit(m) for m in groups["Major"]])
    listed = F.array_distinct(F.filter(given, lambda name: name != "Major"))
    started = F.when(F.array_contains(given, "Major"), F.array_distinct(F.concat(major, listed))).otherwise(listed)
    return F.when(F.array_contains(given, "All"), every).otherwise(started)

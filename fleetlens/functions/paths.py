"""POSIX path arithmetic on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_absolute(path: Column | str) -> Column:
    return F.startswith(_col(path), F.lit("/"))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_path(path: Column | str) -> Column:
    """Everything before the last ``/``; null for a path without one."""
    head = F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)
    return F.when(_col(path).contains("/"), head)


def path_parts(path: Column | str) -> Column:
    """Non-empty parts without ``.``."""
    return F.filter(F.split(_col(path), "/"), lambda part: (part != "") & (part != "."))


def _folded(path: Column | str) -> Column:
    path = _col(path)
    rooted = is_absolute(path)

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        climbs = part == ".."
        return (
            F.when(climbs & last.isNotNull() & (last != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(climbs & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(path_parts(path), F.array().cast("array<string>"), step)


def normalize_path(path: Column | str) -> Column:
    """Path without ``.``, doubled slashes and ``..`` that can be folded."""
    text = F.concat(F.when(is_absolute(path), F.lit("/")).otherwise(F.lit("")), F.array_join(_folded(path), "/"))
    return F.when(text == "", F.lit(".")).otherwise(text)


def relative_path(path: Column | str, base: Column | str) -> Column:
    """``path`` as seen from the directory ``base``; both absolute (or both from one place)."""
    target, start = _folded(path), _folded(base)
    same = F.zip_with(target, start, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_difference = F.array_position(same, F.lit(False))
    common = F.when(first_difference == 0, F.size(same)).otherwise(first_difference.cast("int") - 1)
    up = F.array_repeat(F.lit(".."), F.size(start) - common)
    down = F.slice(target, common + 1, F.size(target))
    text = F.array_join(F.concat(up, down), "/")
    return F.when(text == "", F.lit(".")).otherwise(text)


def move_path(path: Column | str, move: int | str) -> Column:
    """Relative path moved: drop ``move`` leading parts, climb ``-move`` levels, or put a prefix before it.

    Absolute paths stay as they are.
    """
    path = _col(path)
    try:
        count = int(move)
    except ValueError:
        prefix = move.rstrip("/") or "/"
        moved = F.array_join(F.concat(F.array(F.lit(prefix)), path_parts(path)), "/")
        moved = F.regexp_replace(moved, "^//", "/") if prefix == "/" else moved
    else:
        if count <= 0:
            moved = F.array_join(F.concat(F.array_repeat(F.lit(".."), -count), path_parts(path)), "/")
        else:
            parts = path_parts(path)
            moved = F.array_join(F.slice(parts, count + 1, F.greatest(F.size(parts), F.lit(1))), "/")
        moved = F.when(moved == "", F.lit(".")).otherwise(moved)
    return F.when(is_absolute(path), path).otherwise(moved)


def resolve_path(path: Column | str, base: Column | str, relative: bool = False) -> Column:
    """Null-safe: an absolute path made relative to ``base``, or a relative one joined to it and normalized."""
    path, base = _col(path), _col(base)
    if relative:
        return F.when(is_absolute(path), relative_path(path, base)).otherwise(path)
    joined = normalize_path(F.concat(base, F.lit("/"), path))
    return F.when(is_absolute(path), path).otherwise(joined)


def plain_path(uri: Column) -> Column:
    """Path of a file URI as listed on disk; other schemes keep theirs."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def run_of_file(directory: Column) -> Column:
    """Run directory a file belongs to: its directory, or the one above an ``outputs`` directory."""
    return F.regexp_replace(directory, "/outputs$", "")


def path_in_run(directory: Column, name: Column) -> Column:
    return F.when(F.endswith(directory, F.lit("/outputs")), F.concat(F.lit("outputs/"), name)).otherwise(name)

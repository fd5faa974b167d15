"""Configuration documents: typing, defaults, ensemble expansion and checks.

A document is one row with a map of field to JSON literal, so merging an override is work
inside the row, and no field of any document is shuffled on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import (
    canonical_entries,
    declared_types,
    let,
    literal_text,
    object_literals,
    quote,
    typed_value,
)
from ..functions.paths import resolve_path
from ..schemas import (
    ABSENT_DEFAULTS,
    ASWIP_NWS,
    FORCING_NAMES,
    KIND_DEFAULTS,
    KIND_FIELDS,
    KIND_FILE_STEMS,
    REQUIRED_KINDS,
    UNSUPPORTED_FORCINGS,
)


def kind_of_file(file_name: Column | str) -> Column:
    """Document kind of a ``configure_<kind>.json`` file name; null for other files."""
    stem = F.lower(F.regexp_extract(file_name, r"(?i)^configure_(\w+)\.json$", 1))
    for written, kind in KIND_FILE_STEMS.items():
        stem = F.when(stem == written, F.lit(kind)).otherwise(stem)
    return F.when(stem != "", stem)


def _lower_keys(literals: Column) -> Column:
    """Keys lower-cased; of keys that fall together the later one stays. The literals are worked out once."""
    lowered = F.transform(F.map_entries(literals), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))

    def distinct(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e.key)
        latest = F.filter(
            entries,
            lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later.key == e.key),
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(latest)

    return F.map_from_entries(let(lowered, distinct))


def parse_documents(config_docs: DataFrame) -> DataFrame:
    """Add ``fields`` (lower-case field to JSON literal) and ``is_corrupt`` to raw documents."""
    fields = object_literals(F.col("raw"))
    return config_docs.withColumn("fields", _lower_keys(fields)).withColumn("is_corrupt", F.col("fields").isNull())


def config_fields(documents: DataFrame) -> DataFrame:
    """Long form: one row per field with its position and display text.

    The outer explode keeps the optimizer from adding a filter that would parse every document twice.
    """
    entries = documents.select("config_dir", "kind", F.posexplode_outer("fields").alias("pos", "field", "literal"))
    return entries.where("field is not null").select(
        "config_dir", "kind", "pos", "field", literal_text(F.col("literal")).alias("value")
    )


def typed_fields(documents: DataFrame, kind: str) -> DataFrame:
    """Wide view of one kind: a typed column per declared field, others in ``extra`` as display text."""
    declared = KIND_FIELDS[kind]
    others = F.map_filter("fields", lambda k, _: ~k.isin(*declared))
    return documents.where(F.col("kind") == kind).select(
        "config_dir",
        *[
            typed_value(F.try_element_at("fields", F.lit(name)), field_type).alias(name)
            for name, field_type in declared.items()
        ],
        F.transform_values(others, lambda _, literal: literal_text(literal)).alias("extra"),
    )


def _by_kind(defaults: dict[str, dict[str, str]]) -> Column:
    """Map of the defaults of a row's kind."""
    result = F.create_map().cast("map<string,string>")
    for kind, fields in defaults.items():
        pairs = [F.lit(text) for item in fields.items() for text in item]
        result = F.when(F.col("kind") == kind, F.create_map(*pairs)).otherwise(result)
    return result


def _over(base: Column, top: Column) -> Column:
    """Map ``base`` with the entries of ``top`` in place of its own (literals are never SQL null)."""
    return F.map_zip_with(base, top, lambda _, held, given: F.coalesce(given, held))


def fill_defaults(documents: DataFrame, attribute_names: dict[str, list[str]] | None = None) -> DataFrame:
    """Documents with null or absent fields set to the defaults of their kind.

    An e-mail address without a type gets type ``ALL`` and the spinup step follows the model step.
    ``attribute_names`` gives, per kind, the names that fill an absent attribute bag with nulls.
    """
    bags = {
        kind: {"attributes": "{" + ",".join(f'"{name}":null' for name in names) + "}"}
        for kind, names in (attribute_names or {}).items()
    }
    given = F.map_filter("fields", lambda _, literal: literal != "null")
    defaults = {k: {**KIND_DEFAULTS.get(k, {}), **bags.get(k, {})} for k in {**KIND_DEFAULTS, **bags}}
    filled = _over(_by_kind(ABSENT_DEFAULTS), _over(F.col("fields"), _over(_by_kind(defaults), given)))
    out = documents.withColumn("fields", filled)

    def follow(field: str, value: Column, when: Column) -> DataFrame:
        missing = F.coalesce(F.try_element_at("fields", F.lit(field)), F.lit("null")) == "null"
        return out.withColumn(
            "fields",
            F.when(missing & when, _over(F.col("fields"), F.create_map(F.lit(field), value))).otherwise(F.col("fields")),
        )

    address = F.coalesce(F.try_element_at("fields", F.lit("email_address")), F.lit("null"))
    out = follow("email_type", F.lit('"ALL"'), (F.col("kind") == "slurm") & (address != "null"))
    step = F.coalesce(F.try_element_at("fields", F.lit("modeled_timestep")), F.lit("null"))
    return follow("tidal_spinup_timestep", step, F.col("kind").isin("adcirc", "schism"))


def to_document(documents: DataFrame) -> DataFrame:
    """Add ``raw``: the JSON text of each document, nulls kept, keys lower-cased, values in written form."""
    entries = canonical_entries(F.col("kind"), _lower_keys(F.col("fields")))
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), quote(e.key), F.lit(": "), e.value))
    return documents.withColumn(
        "raw",
        F.when(F.size(lines) == 0, F.lit("{}")).otherwise(
            F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
        ),
    )


def _each_path(documents: DataFrame, types: list[str], change) -> DataFrame:
    """Documents with the text of every path field of these types changed; nulls and other literals stay."""

    def changed(declared: Column) -> Column:
        return F.transform_values(
            "fields",
            lambda name, literal: F.when(
                F.try_element_at(declared, name).isin(*types) & F.startswith(literal, F.lit('"')),
                quote(change(literal_text(literal))),
            ).otherwise(literal),
        )

    return documents.withColumn("fields", let(declared_types(F.col("kind")), changed))


def move_paths(documents: DataFrame, folder: Column | str = "config_dir") -> DataFrame:
    """Documents whose relative paths are moved to ``folder`` (by default their configuration's) and made absolute."""
    return _each_path(documents, ["path", "fixed_path"], lambda path: resolve_path(path, folder))


def relative_to(documents: DataFrame, folder: Column | str) -> DataFrame:
    """Documents whose paths are given as seen from ``folder``; fields that are never relative stay."""
    return _each_path(documents, ["path"], lambda path: resolve_path(path, folder, relative=True))


def ensemble_members(documents: DataFrame) -> DataFrame:
    """``(config_dir, run_name, overrides)``: one row per perturbation; overrides null for a plain copy."""
    drivers = documents.where(F.col("kind") == "modeldriver")
    literal = F.coalesce(F.try_element_at("fields", F.lit("perturbations")), F.lit("null"))
    literal = F.when(literal == "null", F.lit('{"unperturbed":null}')).otherwise(literal)
    raw = F.coalesce(F.get_json_object("raw", "$.perturbations"), literal) if "raw" in drivers.columns else literal
    parsed = F.from_json(raw, "map<string,map<string,map<string,variant>>>")
    return drivers.select("config_dir", F.explode(parsed).alias("run_name", "_kinds")).select(
        "config_dir",
        "run_name",
        F.transform_keys(
            F.transform_values(
                "_kinds",
                lambda _, fields: F.transform_values(fields, lambda _k, v: F.coalesce(F.to_json(v), F.lit("null"))),
            ),
            lambda k, _: F.lower(k),
        ).alias("overrides"),
    )


def apply_override(kind: Column, base: Column, override: Column, stop_at_equal: bool = False) -> Column:
    """Base fields with the override's values; unknown fields are added, maps replaced whole.

    With ``stop_at_equal`` the override ends, in its own order, at the first field whose value
    equals the base's.
    """
    kept = override
    if stop_at_equal:
        held = F.map_from_entries(canonical_entries(kind, F.map_filter(base, lambda k, _: F.map_contains_key(override, k))))
        equal = let(
            held,
            lambda known: F.transform(
                canonical_entries(kind, override),
                lambda e: F.coalesce(F.try_element_at(known, e.key) == e.value, F.lit(False)),
            ),
        )
        first_equal = F.array_position(equal, F.lit(True)).cast("int")
        entries = F.map_entries(override)
        kept = let(
            first_equal,
            lambda at: F.map_from_entries(F.slice(entries, 1, F.when(at > 0, at - 1).otherwise(F.size(entries)))),
        )
    return F.when(override.isNull(), base).otherwise(_over(base, kept))


def overlay(documents: DataFrame, members: DataFrame, stop_at_equal: bool = False) -> DataFrame:
    """``(config_dir, run_name, kind, fields)``: each member's documents after its overrides.

    Documents and members both grow with the fleet, and sizes estimated from compressed files are far too small for maps, so neither is broadcast.
    A task holds the documents of its configurations, a few each; members, which are many and wide, are neither held nor sorted.
    """
    override = F.try_element_at("overrides", F.col("kind"))
    return (
        documents.select("config_dir", "kind", "fields")
        .hint("shuffle_hash")
        .join(members.select("config_dir", "run_name", "overrides"), "config_dir")
        .select(
            "config_dir",
            "run_name",
            "kind",
            apply_override(F.col("kind"), F.col("fields"), override, stop_at_equal).alias("fields"),
        )
    )


def expand_ensemble(documents: DataFrame, stop_at_equal: bool = False) -> DataFrame:
    """One set of documents per ensemble member."""
    return overlay(documents, ensemble_members(documents), stop_at_equal)


def dropped_overrides(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Warnings: overrides of a kind the configuration does not hold."""
    return (
        members.select("config_dir", "run_name", F.explode(F.map_keys("overrides")).alias("kind"))
        .join(documents.select("config_dir", "kind").hint("merge"), ["config_dir", "kind"], "left_anti")
    )


def ensemble_size(members: DataFrame) -> DataFrame:
    return members.groupBy("config_dir").agg(F.count(F.lit(1)).alias("members"))


def missing_required(config_docs: DataFrame, model: str) -> DataFrame:
    """``(config_dir, kind)`` of required documents that are not there."""
    kinds = REQUIRED_KINDS[model]
    present = config_docs.groupBy("config_dir").agg(
        *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in kinds]
    )
    absent = F.filter(F.array(*[F.when(~F.col(k), F.lit(k)) for k in kinds]), lambda k: k.isNotNull())
    return present.select("config_dir", F.explode(absent).alias("kind"))


def duplicate_required(config_docs: DataFrame, model: str) -> DataFrame:
    """``(config_dir, kind, copies)`` of required documents given more than once."""
    return (
        config_docs.where(F.col("kind").isin(*REQUIRED_KINDS[model]))
        .groupBy("config_dir", "kind")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def effective_forcings(forcings: DataFrame, by: str = "kind", position: str = "pos") -> DataFrame:
    """One forcing per kind: the latest one, in the place of the first."""
    rest = [c for c in forcings.columns if c not in ("config_dir", by, position)]
    return (
        forcings.groupBy("config_dir", by)
        .agg(F.min(position).alias(position), F.max_by(F.struct(*rest), F.col(position)).alias("_latest"))
        .select("config_dir", by, position, "_latest.*")
    )


def valid_forcings(names: DataFrame, model: str, column: str = "forcing") -> DataFrame:
    return names.where(F.lower(F.trim(column)).isin(*FORCING_NAMES[model]))


def unknown_forcings(names: DataFrame, model: str, column: str = "forcing") -> DataFrame:
    return names.where(~F.lower(F.trim(column)).isin(*FORCING_NAMES[model]))


def unsupported_forcings(documents: DataFrame, model: str) -> DataFrame:
    """Documents of forcings the model cannot take."""
    return documents.where(F.col("kind").isin(*UNSUPPORTED_FORCINGS[model]))


def supported_forcings(documents: DataFrame, model: str) -> DataFrame:
    return documents.where(~F.col("kind").isin(*UNSUPPORTED_FORCINGS[model]))


def use_aswip(nws: Column | str, executable: Column | str) -> Column:
    """Whether the run needs the asymmetric-wind preprocessor and has it."""
    nws = F.col(nws) if isinstance(nws, str) else nws
    executable = F.col(executable) if isinstance(executable, str) else executable
    return F.coalesce(nws.isin(*ASWIP_NWS), F.lit(False)) & executable.isNotNull()


def same_document(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(config_dir, kind, is_same)`` over the documents of both sides; a missing one differs."""

    def side(documents: DataFrame, name: str) -> DataFrame:
        entries = canonical_entries(F.col("kind"), F.col("fields"))
        return documents.select("config_dir", "kind", F.array_sort(entries).alias(name))

    return side(left, "l").join(side(right, "r"), ["config_dir", "kind"], "full_outer").select(
        "config_dir", "kind", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("is_same")
    )


def infer_glob(paths: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Common directory and simple pattern of each group of file paths.

    The common parts of a set are those of its smallest and largest member, so two extremes
    per group are enough. ``error`` is set when the paths lie at different depths.
    """
    parts = F.split(F.col(path), "/")
    folder = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    grouped = paths.groupBy(*keys).agg(
        F.min(folder).alias("_first"),
        F.max(folder).alias("_last"),
        F.min(F.size(parts)).alias("_shallow"),
        F.max(F.size(parts)).alias("_deep"),
        F.min(suffix).alias("_suffix"),
        F.max(suffix).alias("_suffix_last"),
        F.min(path).alias("_path"),
        F.max(path).alias("_path_last"),
    )
    same = F.zip_with("_first", "_last", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_difference = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(first_difference == 0, F.size(same)).otherwise(first_difference - 1)
    one = F.col("_path") == F.col("_path_last")
    mixed = F.col("_shallow") != F.col("_deep")
    ending = F.when(F.col("_suffix") == F.col("_suffix_last"), F.col("_suffix")).otherwise(F.lit(".*"))
    below = F.col("_deep") - 1 - F.col("_common")
    root = F.array_join(F.slice("_first", 1, F.col("_common")), "/")
    return grouped.withColumn("_common", common).select(
        *keys,
        F.when((root == "") & F.startswith(F.col("_path"), F.lit("/")), F.lit("/")).otherwise(root).alias("root"),
        F.when(one, F.element_at(F.split("_path", "/"), -1))
        .when(~mixed, F.concat(F.repeat(F.lit("*/"), below), F.lit("*"), ending))
        .alias("pattern"),
        F.when(mixed & ~one, F.lit("paths lie at different depths")).alias("error"),
    )

"""Checks of configuration documents: typing, overlays, required kinds, paths, dates and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import parse_datetime, parse_duration, walltime
from ..functions.literals import literal_text
from ..functions.names import constituent_group, normalize_constituents, parse_enum
from ..functions.paths import move_path, normalize_path, relative_path, resolve_path
from ..operators.config import (
    config_fields,
    dropped_overrides,
    duplicate_required,
    effective_forcings,
    ensemble_members,
    ensemble_size,
    expand_ensemble,
    fill_defaults,
    infer_glob,
    kind_of_file,
    missing_required,
    overlay,
    parse_documents,
    same_document,
    supported_forcings,
    to_document,
    typed_fields,
    unknown_forcings,
    unsupported_forcings,
    use_aswip,
    valid_forcings,
)
from ..schemas import EMAIL_TYPES
from .registry import check, table


def _quoted(*parts):
    return F.concat(F.lit('"'), *parts, F.lit('"'))


def _part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as the model document of a configuration, with a second document beside it."""
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("config_dir"), "p_size", "p_name", "p_retailprice", "p_brand"
    )
    model = F.create_map(
        F.lit("processors"), F.col("p_size").cast("string"),
        F.lit("fort_14_path"), _quoted("p_name"),
        F.lit("modeled_timestep"), F.floor("p_retailprice").cast("string"),
        F.lit("output_surface"), F.lit("true"),
    )
    slurm = F.create_map(F.lit("account"), _quoted("p_brand"), F.lit("nodes"), F.lit("null"))
    docs = F.array(
        F.struct(F.lit("adcirc").alias("kind"), model.alias("fields")),
        F.struct(F.lit("slurm").alias("kind"), slurm.alias("fields")),
    )
    return part.select("config_dir", F.explode(docs).alias("d")).select("config_dir", "d.*")


_PART_FIELDS = """base AS (
  SELECT 'p' || p_partkey AS config_dir, unnest(['adcirc', 'adcirc', 'adcirc', 'adcirc', 'slurm', 'slurm']) AS kind,
         unnest(['processors', 'fort_14_path', 'modeled_timestep', 'output_surface', 'account', 'nodes']) AS field,
         unnest([CAST(p_size AS VARCHAR), p_name, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR), 'true', p_brand, NULL]) AS value
  FROM part)"""


def _line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line of a part as one ensemble member of the part's configuration.

    Lines are dealt by their key before they are grouped: a smallest flag, being text, takes a sort, and keys seldom meet within a file split,
    so grouping splits first would sort all lines of each and shuffle as many.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_orderkey", "l_quantity", "l_returnflag")
        .repartition("l_partkey", "l_orderkey")
        .groupBy("l_partkey", "l_orderkey")
        .agg(F.min("l_quantity").cast("bigint").alias("q"), F.min("l_returnflag").alias("flag"))
    )
    model = F.create_map(
        F.lit("ICS"), F.col("q").cast("string"),
        F.lit("processors"), F.col("q").cast("string"),
        F.lit("output_surface"), F.when(F.col("flag") == "A", F.lit("false")).otherwise(F.lit("true")),
        F.lit("fort_14_path"), _quoted("flag"),
    )
    unknown = F.create_map(F.lit("constituents"), F.lit('"all"'))
    overrides = F.when(F.col("flag") != "N", F.create_map(F.lit("adcirc"), model, F.lit("tidalforcing"), unknown))
    return lines.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("config_dir"),
        F.concat(F.lit("run_"), F.col("l_orderkey")).alias("run_name"),
        overrides.alias("overrides"),
    )


_LINE_MEMBERS = """members AS (
  SELECT 'p' || l_partkey AS config_dir, 'run_' || l_orderkey AS run_name,
         CAST(min(l_quantity) AS BIGINT) AS q, min(l_returnflag) AS flag
  FROM lineitem GROUP BY l_partkey, l_orderkey),
changes AS (
  SELECT config_dir, run_name, 'adcirc' AS kind, unnest([0, 1, 2, 3]) AS pos,
         unnest(['ICS', 'processors', 'output_surface', 'fort_14_path']) AS field,
         unnest([CAST(q AS VARCHAR), CAST(q AS VARCHAR), CASE WHEN flag = 'A' THEN 'false' ELSE 'true' END, flag]) AS value
  FROM members WHERE flag <> 'N')"""


def _flat(member_docs: DataFrame) -> DataFrame:
    return member_docs.select(
        "config_dir", "run_name", "kind", F.explode_outer("fields").alias("field", "literal")
    ).where("field is not null").select("config_dir", "run_name", "kind", "field", literal_text(F.col("literal")).alias("value"))


def _overlay_sql(changes: str) -> str:
    return f"""WITH {_PART_FIELDS}, {_LINE_MEMBERS}, {changes},
spread AS (SELECT b.config_dir, m.run_name, b.kind, b.field, b.value FROM base b JOIN members m USING (config_dir)),
applied_here AS (SELECT a.* FROM applied a WHERE EXISTS (SELECT 1 FROM base b WHERE b.config_dir = a.config_dir AND b.kind = a.kind))
SELECT coalesce(s.config_dir, a.config_dir) AS config_dir, coalesce(s.run_name, a.run_name) AS run_name,
       coalesce(s.kind, a.kind) AS kind, coalesce(s.field, a.field) AS field,
       CASE WHEN a.field IS NOT NULL THEN a.value ELSE s.value END AS value
FROM spread s FULL JOIN applied_here a
  ON s.config_dir = a.config_dir AND s.run_name = a.run_name AND s.kind = a.kind AND s.field = a.field"""


@check(_overlay_sql("applied AS (SELECT * FROM changes)"))
def overlay_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(overlay(_part_documents(spark, sf_dir), _line_members(spark, sf_dir)))


@check(
    _overlay_sql(
        """equal AS (SELECT c.config_dir, c.run_name, min(c.pos) AS stop FROM changes c JOIN base b
             ON b.config_dir = c.config_dir AND b.kind = c.kind AND b.field = c.field AND b.value = c.value GROUP BY ALL),
applied AS (SELECT c.* FROM changes c LEFT JOIN equal e USING (config_dir, run_name) WHERE e.stop IS NULL OR c.pos < e.stop)"""
    )
)
def overlay_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(overlay(_part_documents(spark, sf_dir), _line_members(spark, sf_dir), stop_at_equal=True))


@check(
    f"""WITH {_LINE_MEMBERS}
SELECT config_dir, run_name, 'tidalforcing' AS kind FROM members
WHERE flag <> 'N' AND config_dir IN (SELECT 'p' || p_partkey FROM part)"""
)
def overlay_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_overrides(_part_documents(spark, sf_dir), _line_members(spark, sf_dir))


def _customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a configuration of a driver document with up to two members, and a model document."""
    customer = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    runs = (
        F.when(
            F.col("c_custkey") % 3 == 0,
            F.concat(F.lit('{"b": {"ADCIRC": {"processors": '), nation, F.lit('}}, "a": null}')),
        )
        .when(F.col("c_custkey") % 3 == 1, F.lit("null"))
        .otherwise(F.lit('{"only": {"adcirc": {"fort_13_path": "x\\"y", "attributes": {"IM": 1}}}}'))
    )
    driver = F.concat(F.lit('{"Platform": "HERA", "perturbations": '), runs, F.lit("}"))
    model = F.concat(
        F.lit('{"processors": 11, "FORT_13_path": null, "attributes": {"IM": 0, "ICS": 2}, "note": "'),
        F.col("c_mktsegment"), F.lit('"}'),
    )
    docs = F.array(
        F.struct(F.lit("modeldriver").alias("kind"), driver.alias("raw")),
        F.struct(F.lit("adcirc").alias("kind"), model.alias("raw")),
    )
    rows = customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("config_dir"), F.explode(docs).alias("d"))
    return parse_documents(rows.select("config_dir", "d.*"))


@check(
    """WITH c AS (SELECT 'c' || c_custkey AS config_dir, c_custkey % 3 AS kind_of, c_nationkey, c_mktsegment FROM customer),
m AS (SELECT *, unnest(CASE kind_of WHEN 0 THEN ['b', 'a'] WHEN 1 THEN ['unperturbed'] ELSE ['only'] END) AS run_name FROM c)
SELECT config_dir, run_name, 'adcirc' AS kind, unnest(['processors', 'fort_13_path', 'attributes', 'note']) AS field,
       unnest([CASE WHEN run_name = 'b' THEN CAST(c_nationkey AS VARCHAR) ELSE '11' END,
               CASE WHEN run_name = 'only' THEN 'x"y' END,
               CASE WHEN run_name = 'only' THEN '{"IM":1}' ELSE '{"ICS":2,"IM":0}' END, c_mktsegment]) AS value FROM m"""
)
def expand_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(expand_ensemble(_customer_documents(spark, sf_dir)).where("kind = 'adcirc'"))


@check(
    """SELECT 'c' || c_custkey AS config_dir, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS members FROM customer"""
)
def ensemble_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble_size(ensemble_members(_customer_documents(spark, sf_dir)))


@check(
    """SELECT 'c' || c_custkey AS config_dir, 'adcirc' AS kind, unnest([0, 1, 2, 3]) AS pos,
       unnest(['processors', 'fort_13_path', 'attributes', 'note']) AS field,
       unnest(['11', NULL, '{"ICS":2,"IM":0}', c_mktsegment]) AS value FROM customer"""
)
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_fields(_customer_documents(spark, sf_dir).where("kind = 'adcirc'"))


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job documents; every seventh one is cut off and so malformed."""
    events = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    raw = F.concat(
        F.lit('{"NODES": '), k, F.lit(', "account": "'), F.col("event_type"),
        F.lit('", "job_duration": "'), k, F.lit(':00:30", "modules": "'), F.col("event_type"),
        F.lit('", "extra_'), F.col("user_id") % 3, F.lit('": '), F.col("props"),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return parse_documents(
        events.select(
            F.concat(F.lit("e"), F.col("event_id")).alias("config_dir"), F.lit("slurm").alias("kind"), raw.alias("raw")
        )
    )


_EVENT_K = """e AS (SELECT 'e' || event_id AS config_dir, event_id, event_type, user_id,
                CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


@check(
    f"""WITH {_EVENT_K}
SELECT config_dir, CASE WHEN event_id % 7 <> 0 THEN event_type END AS account, CASE WHEN event_id % 7 <> 0 THEN k END AS nodes,
       CASE WHEN event_id % 7 <> 0 THEN CAST(k * 3600 + 30 AS DOUBLE) END AS job_duration,
       CASE WHEN event_id % 7 <> 0 THEN event_type END AS modules,
       CASE WHEN event_id % 7 <> 0 THEN '{{"extra_' || (user_id % 3) || '":"{{\\"k\\":' || k || '}}"}}' END AS extra FROM e"""
)
def typed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = typed_fields(_event_documents(spark, sf_dir), "slurm")
    return wide.select(
        "config_dir", "account", "nodes", "job_duration", F.array_join("modules", ",").alias("modules"),
        F.to_json("extra").alias("extra"),
    )


@check(
    f"""WITH {_EVENT_K}
SELECT config_dir, '{{\n  "nodes": ' || k || ',\n  "account": "' || event_type || '",\n  "job_duration": ' || (k * 3600 + 30) ||
       '.0,\n  "modules": ["' || event_type || '"],\n  "extra_' || (user_id % 3) || '": {{"k":' || k || '}}\n}}' AS raw
FROM e WHERE event_id % 7 <> 0"""
)
def written_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_document(_event_documents(spark, sf_dir).where("not is_corrupt")).select("config_dir", "raw")


@check(
    """WITH p AS (SELECT 'p' || p_partkey AS config_dir, p_partkey % 4 AS m, p_size FROM part)
SELECT config_dir, unnest(['surface_output_interval', 'processors', 'tidal_spinup_timestep', 'output_surface', 'attributes']) AS field,
       unnest([CASE WHEN m = 0 THEN '60' ELSE '3600.0' END, CASE WHEN m = 1 THEN CAST(p_size AS VARCHAR) ELSE '11' END,
               CAST(p_size AS VARCHAR), CASE WHEN m = 2 THEN NULL ELSE 'true' END, '{"IM":null,"ICS":null}']) AS value FROM p"""
)
def filled_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    fields = F.map_from_entries(
        F.array_compact(
            F.array(
                F.struct(F.lit("modeled_timestep"), size),
                F.struct(F.lit("surface_output_interval"), F.when(m == 0, F.lit("60")).otherwise(F.lit("null"))),
                F.when(m == 1, F.struct(F.lit("processors"), size)),
                F.when(m == 2, F.struct(F.lit("output_surface"), F.lit("null"))),
            )
        )
    )
    docs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("config_dir"), F.lit("adcirc").alias("kind"), fields.alias("fields")
    )
    filled = fill_defaults(docs, {"adcirc": ["IM", "ICS"]})
    names = ["surface_output_interval", "processors", "tidal_spinup_timestep", "output_surface", "attributes"]
    return config_fields(filled).where(F.col("field").isin(*names)).select("config_dir", "field", "value")


def _order_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["modeldriver", "slurm", "adcirc", "tidal", "atmesh"]
    names = F.array(*[F.lit(kind) for kind in kinds])
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("config_dir"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("resource"),
    )


_ORDER_KINDS = """docs AS (SELECT 'c' || o_custkey AS config_dir,
       ['modeldriver', 'slurm', 'adcirc', 'tidal', 'atmesh'][(o_orderkey % 5) + 1] AS kind,
       o_orderkey AS pos, o_orderpriority AS resource FROM orders)"""


@check(
    f"""WITH {_ORDER_KINDS}
SELECT d.config_dir, k.kind FROM (SELECT DISTINCT config_dir FROM docs) d, (VALUES ('modeldriver'), ('slurm'), ('adcirc')) k(kind)
WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.config_dir = d.config_dir AND x.kind = k.kind)"""
)
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_required(_order_kinds(spark, sf_dir), "ADCIRC")


@check(
    f"""WITH {_ORDER_KINDS} SELECT config_dir, kind, count(*) AS copies FROM docs
WHERE kind IN ('modeldriver', 'slurm', 'adcirc') GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_required(_order_kinds(spark, sf_dir), "ADCIRC")


@check(
    f"""WITH {_ORDER_KINDS} SELECT config_dir, kind, min(pos) AS pos, arg_max(resource, pos) AS resource FROM docs GROUP BY ALL"""
)
def forcings_in_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_forcings(_order_kinds(spark, sf_dir))


_KINDS = ["tidal", "besttrack", "owi", "atmesh", "ww3data", "nwm", "sflux", "slurm"]


def _part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(kind) for kind in _KINDS])
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("kind")
    )


@check(
    f"""WITH k AS (SELECT p_partkey, {_KINDS}[(p_partkey % 8) + 1] AS kind FROM part)
SELECT p_partkey, kind, 'ADCIRC' AS model, kind NOT IN ('nwm', 'sflux') AS supported FROM k
UNION ALL SELECT p_partkey, kind, 'SCHISM', kind NOT IN ('owi', 'atmesh', 'ww3data') FROM k"""
)
def forcing_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _part_kinds(spark, sf_dir)
    result = None
    for model in ("ADCIRC", "SCHISM"):
        for rows, flag in ((supported_forcings(docs, model), True), (unsupported_forcings(docs, model), False)):
            part = rows.withColumn("model", F.lit(model)).withColumn("supported", F.lit(flag))
            result = part if result is None else result.unionByName(part)
    return result


@check(
    f"""WITH k AS (SELECT p_partkey, upper({_KINDS}[(p_partkey % 8) + 1]) || ' ' AS forcing FROM part)
SELECT p_partkey, forcing, lower(trim(forcing)) IN ('tidal', 'atmesh', 'besttrack', 'owi', 'ww3data') AS known FROM k"""
)
def forcing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _part_kinds(spark, sf_dir).select("p_partkey", F.concat(F.upper("kind"), F.lit(" ")).alias("forcing"))
    known = valid_forcings(names, "ADCIRC").withColumn("known", F.lit(True))
    return known.unionByName(unknown_forcings(names, "ADCIRC").withColumn("known", F.lit(False)))


@check(
    """SELECT p_partkey, p_size IN (8, 19, 20, 21) AND p_partkey % 3 <> 0 AS aswip FROM part"""
)
def aswip_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    executable = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", use_aswip(F.col("p_size"), executable).alias("aswip"))


@check(
    """WITH l AS (SELECT p_partkey AS k, p_size, p_name FROM part WHERE p_type <> 'ECONOMY'),
r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END AS p_size, p_name FROM part WHERE p_type <> 'SMALL')
SELECT 'p' || coalesce(l.k, r.k) AS config_dir, 'atmesh' AS kind,
       l.k IS NOT NULL AND r.k IS NOT NULL AND coalesce(l.p_size = r.p_size, false) AS is_same
FROM l FULL JOIN r ON l.k = r.k"""
)
def same_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy with other key order and number form; some changed, some on one side only."""
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("p"), F.col("p_partkey")).alias("config_dir")
    kind = F.lit("atmesh").alias("kind")
    size = F.col("p_size")
    other = F.when(F.col("p_partkey") % 2 == 0, size).otherwise(size + 1)
    left = part.where("p_type <> 'ECONOMY'").select(
        key, kind,
        F.create_map(F.lit("nws"), size.cast("string"), F.lit("interval"), F.concat(size, F.lit("0")),
                     F.lit("resource"), _quoted("p_name")).alias("fields"),
    )
    right = part.where("p_type <> 'SMALL'").select(
        key, kind,
        F.create_map(F.lit("resource"), _quoted("p_name"), F.lit("interval"), F.concat(size, F.lit("0.0")),
                     F.lit("nws"), other.cast("string")).alias("fields"),
    )
    return same_document(left, right)


@check(
    """WITH s AS (SELECT p_partkey, ['configure_tidal.json', 'Configure_ADCIRC.JSON', 'configure_sfluxfiles.json', 'fort.15'][(p_partkey % 4) + 1] AS file_name FROM part)
SELECT p_partkey, ['tidal', 'adcirc', 'sflux', NULL][(p_partkey % 4) + 1] AS kind FROM s"""
)
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("configure_tidal.json", "Configure_ADCIRC.JSON", "configure_sfluxfiles.json", "fort.15")])
    return table(spark, sf_dir, "part").select(
        "p_partkey", kind_of_file(F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("kind")
    )


@check(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(l_orderkey AS DOUBLE) AS plain,
       CAST((l_orderkey % 99) * 86400 + l_linenumber * 3600 + (l_partkey % 60) * 60 + l_suppkey % 60 AS DOUBLE) AS days,
       CAST(l_linenumber * 3600 + (l_partkey % 60) * 60 + l_suppkey % 60 AS DOUBLE) AS hours,
       CAST(NULL AS DOUBLE) AS bad,
       printf('%02d:%02d:%02d', l_orderkey // 3600, (l_orderkey % 3600) // 60, l_orderkey % 60) AS wall FROM lineitem"""
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.concat_ws(":", "l_linenumber", F.col("l_partkey") % 60, F.col("l_suppkey") % 60)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        parse_duration(F.col("l_orderkey").cast("string")).alias("plain"),
        parse_duration(F.concat_ws(":", F.col("l_orderkey") % 99, hours)).alias("days"),
        parse_duration(hours).alias("hours"),
        parse_duration(F.concat(hours, F.lit(":x"))).alias("bad"),
        walltime("l_orderkey").alias("wall"),
    )


@check(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS compact, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso,
       strftime(o_orderdate + to_hours(CAST(o_custkey % 24 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS hour, CAST(NULL AS VARCHAR) AS bad FROM orders"""
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    shown = lambda c: parse_datetime(c).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        shown(day).alias("compact"),
        shown(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"),
        shown(F.concat(day, F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"))).alias("hour"),
        shown(F.concat(F.lit("on "), day)).alias("bad"),
    )


@check(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ALL' WHEN 1 THEN 'TIME_LIMIT_90' WHEN 2 THEN 'FAIL' END AS email_type FROM orders"""
)
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.lit("all"), F.lit(" Time_Limit_90"), F.lit("FAIL"), F.lit("sometimes"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parse_enum(F.element_at(given, (F.col("o_orderkey") % 4 + 1).cast("int")), EMAIL_TYPES).alias("email_type")
    )


_URL_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


@check(
    f"""WITH p AS (SELECT page_id, regexp_replace({_URL_PATH}, '/$', '') AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, '../' || array_to_string(CASE WHEN parts[1] = 'en' THEN parts[2:] ELSE list_prepend('..', parts) END, '/') AS from_en,
       array_to_string(parts[2:], '/') AS dropped,
       '../../' || array_to_string(parts, '/') AS climbed, '/data/x/' || array_to_string(parts, '/') AS prefixed,
       path AS kept, '/data/' || array_to_string(parts, '/') AS resolved,
       '/' || array_to_string(list_append(parts[:len(parts) - 1], 'q'), '/') AS folded
FROM s"""
)
def path_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "/$", "")
    local = F.substr(F.col("path"), F.lit(2))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select(
        "page_id",
        relative_path(F.col("path"), F.lit("/en/base")).alias("from_en"),
        move_path(local, 1).alias("dropped"),
        move_path(local, -2).alias("climbed"),
        move_path(local, "/data/x").alias("prefixed"),
        move_path(F.col("path"), 3).alias("kept"),
        resolve_path(F.concat(F.lit("a/../"), local), F.lit("/data/./")).alias("resolved"),
        normalize_path(F.concat("path", F.lit("/../q"))).alias("folded"),
    )


@check(
    """WITH f AS (SELECT c_nationkey AS k, c_mktsegment AS seg, '/forcings/' || c_nationkey || '/' || c_mktsegment || '/wind_' || c_custkey ||
              CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN '.grb' ELSE '.nc' END AS path,
              CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN '.grb' ELSE '.nc' END AS suffix FROM customer)
SELECT k, CASE WHEN count(DISTINCT seg) = 1 THEN '/forcings/' || k || '/' || min(seg) ELSE '/forcings/' || k END AS root,
       CASE WHEN count(*) = 1 THEN split_part(min(path), '/', 5)
            ELSE CASE WHEN count(DISTINCT seg) = 1 THEN '' ELSE '*/' END || '*' ||
                 CASE WHEN count(DISTINCT suffix) = 1 THEN min(suffix) ELSE '.*' END END AS pattern,
       CAST(NULL AS VARCHAR) AS error
FROM f GROUP BY k"""
)
def inferred_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when((F.col("c_nationkey") % 3 == 0) & (F.col("c_custkey") % 2 == 0), ".grb").otherwise(".nc")
    files = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("k"),
        F.concat(
            F.lit("/forcings/"), F.col("c_nationkey"), F.lit("/"), F.col("c_mktsegment"), F.lit("/wind_"), F.col("c_custkey"), suffix
        ).alias("path"),
    )
    return infer_glob(files, ["k"])


# Constituent lists of the check's own tidal source.
_GROUPS = {"All": ["Q1", "O1", "P1", "K1", "M2", "Mm"], "Major": ["Q1", "O1", "K1", "M2"]}


@check(
    """WITH p AS (SELECT p_partkey, p_partkey % 6 AS m FROM part),
t AS (SELECT *, CASE m WHEN 0 THEN ['all'] WHEN 1 THEN ['major', 'mm'] WHEN 2 THEN ['m2', 'k1', 'q1', 'o1']
                      WHEN 3 THEN ['mm', 'm2', 'k1', 'p1', 'o1', 'q1'] WHEN 4 THEN ['m2', 'M2', 'k1'] ELSE ['major', 'k1'] END AS given FROM p)
SELECT p_partkey, CASE WHEN list_sort(list_transform(given, lambda x: upper(x))) = ['K1', 'M2', 'O1', 'Q1'] THEN 'Major'
                       WHEN list_sort(list_transform(given, lambda x: upper(x))) = ['K1', 'M2', 'MM', 'O1', 'P1', 'Q1'] THEN 'All' END AS spelled,
       CASE m WHEN 0 THEN 'Q1,O1,P1,K1,M2,Mm' WHEN 1 THEN 'Q1,O1,K1,M2,Mm' WHEN 2 THEN 'Q1,O1,K1,M2'
              WHEN 3 THEN 'Q1,O1,P1,K1,M2,Mm' WHEN 4 THEN 'M2,K1' ELSE 'Q1,O1,K1,M2' END AS active FROM t"""
)
def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [["all"], ["major", "mm"], ["m2", "k1", "q1", "o1"], ["mm", "m2", "k1", "p1", "o1", "q1"], ["m2", "M2", "k1"], ["major", "k1"]]
    given = F.array(*[F.array(*[F.lit(n) for n in names]) for names in lists])
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", F.element_at(given, (F.col("p_partkey") % 6 + 1).cast("int")).alias("given"))
        .select(
            "p_partkey",
            constituent_group("given", _GROUPS).alias("spelled"),
            F.array_join(normalize_constituents("given", _GROUPS), ",").alias("active"),
        )
    )

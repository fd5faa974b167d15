"""Checks of meshes, tracks, lengths and tree comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesic import ellipsoidal_distance
from ..operators.diff import diff_sizes, diff_trees
from ..operators.mesh import dense_attributes, mesh_classes, same_mesh, without_attributes
from ..operators.track import clip_track, path_length, storm_ids
from ..sources.geo import parse_best_track
from ..sources.text import number_text_lines
from .registry import check, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes of one mesh per brand."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("mesh_id"), F.col("p_partkey").alias("node_id"),
        F.col("p_size").cast("double").alias("x"), F.floor("p_retailprice").cast("double").alias("y"),
    )


@check(
    """WITH a AS (SELECT p_brand AS mesh_id, attribute, base FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('tau0', 0.5), ('manning', 0.25)) v(attribute, base)
           WHERE NOT (p_brand = 'Brand#7' AND attribute = 'tau0')),
e AS (SELECT p_brand AS mesh_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'tau0' ELSE 'manning' END AS attribute,
             p_partkey AS node_id, max(l_quantity) AS value
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p.p_brand AS mesh_id, a.attribute, p.p_partkey AS node_id, CAST(coalesce(e.value, a.base) AS DOUBLE) AS value
FROM part p JOIN a ON a.mesh_id = p.p_brand LEFT JOIN e ON e.mesh_id = a.mesh_id AND e.attribute = a.attribute AND e.node_id = p.p_partkey"""
)
def dense_node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    pair = lambda name, value: F.struct(F.lit(name).alias("attribute"), F.lit(value).alias("value"))
    defaults = (
        nodes.select("mesh_id").distinct()
        .select("mesh_id", F.explode(F.array(pair("tau0", 0.5), pair("manning", 0.25))).alias("a"))
        .select("mesh_id", "a.*")
        .where(~((F.col("mesh_id") == "Brand#7") & (F.col("attribute") == "tau0")))
    )
    exceptions = (
        table(spark, sf_dir, "lineitem")
        .withColumn("attribute", F.when(F.expr("l_returnflag = 'R' and l_linenumber = 1"), F.lit("tau0")).otherwise(F.lit("manning")))
        .groupBy(F.col("l_partkey").alias("node_id"), "attribute").agg(F.max("l_quantity").alias("value"))
        .join(nodes.select("mesh_id", "node_id"), "node_id")
        .select("mesh_id", "attribute", "node_id", "value")
    )
    return dense_attributes(nodes, defaults, exceptions)


@check("SELECT DISTINCT p_brand AS mesh_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def meshes_without_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    defaults = nodes.where(~F.col("mesh_id").isin("Brand#1", "Brand#2")).select("mesh_id").distinct()
    return without_attributes(nodes, defaults)


@check(
    """WITH l AS (SELECT p_brand AS mesh_id, p_partkey AS node_id, p_size AS x FROM part WHERE NOT (p_brand = 'Brand#3' AND p_partkey % 2 = 0)),
r AS (SELECT p_brand AS mesh_id, p_partkey AS node_id, CASE WHEN p_brand = 'Brand#4' AND p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS x FROM part)
SELECT coalesce(l.mesh_id, r.mesh_id) AS mesh_id, count(*) FILTER (WHERE l.x IS DISTINCT FROM r.x) AS mismatches,
       count(*) FILTER (WHERE l.x IS DISTINCT FROM r.x) = 0 AS is_same
FROM l FULL JOIN r ON l.mesh_id = r.mesh_id AND l.node_id = r.node_id GROUP BY 1"""
)
def same_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    left = nodes.where(~((F.col("mesh_id") == "Brand#3") & (F.col("node_id") % 2 == 0)))
    moved = (F.col("mesh_id") == "Brand#4") & (F.col("node_id") % 3 == 0)
    right = nodes.withColumn("x", F.when(moved, F.col("x") + 1).otherwise(F.col("x")))
    return same_mesh(left, right, ["node_id"], ["x", "y"])


@check(
    """WITH w AS (SELECT user_id, min(ts) + to_days(CAST(user_id % 7 AS INTEGER)) AS a,
                  CASE WHEN user_id % 5 = 0 THEN max(ts) ELSE min(ts) + to_days(CAST(user_id % 7 + user_id % 4 AS INTEGER)) END AS b
           FROM events GROUP BY 1)
SELECT 'c' || user_id AS config_dir, 's' || user_id AS storm_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
FROM events JOIN w USING (user_id) WHERE ts BETWEEN a AND b"""
)
def clipped_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    storm = F.concat(F.lit("s"), F.col("user_id"))
    shift = lambda days: F.make_dt_interval(days=days.cast("int"))
    windows = events.groupBy("user_id").agg(F.min("ts").alias("first")).select(
        F.concat(F.lit("c"), F.col("user_id")).alias("config_dir"),
        storm.alias("storm_id"),
        (F.col("first") + shift(F.col("user_id") % 7)).alias("start_ts"),
        F.when(F.col("user_id") % 5 != 0, F.col("first") + shift(F.col("user_id") % 7 + F.col("user_id") % 4)).alias("end_ts"),
    )
    clipped = clip_track(events.select(storm.alias("storm_id"), "event_id", "ts"), windows)
    return clipped.select("config_dir", "storm_id", "event_id", F.substring(F.col("ts").cast("string"), 1, 19).alias("at"))


@check(
    """SELECT event_id, 's' || user_id AS storm_id, 'AL' AS basin, lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') AS storm_number,
       strftime(ts, '%Y-%m-%d %H:00:00') AS at,
       CAST(CASE WHEN event_type = 'view' THEN -(event_id % 900) ELSE event_id % 900 END AS DOUBLE) / 10 + 0.0 AS lat,
       CAST(CASE WHEN event_type = 'click' THEN event_id % 1800 ELSE -(event_id % 1800) END AS DOUBLE) / 10 + 0.0 AS lon,
       CAST(floor(value) AS INTEGER) AS max_wind, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'NEQ' END AS quadrant FROM events"""
)
def parsed_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as best-track lines and read back."""
    e = table(spark, sf_dir, "events")
    lat = F.concat(F.col("event_id") % 900, F.when(F.col("event_type") == "view", "S").otherwise("N"))
    lon = F.concat(F.col("event_id") % 1800, F.when(F.col("event_type") == "click", "E").otherwise("W"))
    line = F.concat_ws(
        ", ", F.lit("AL"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.date_format("ts", "yyyyMMddHH"),
        F.lit("  "), F.lit("BEST"), F.lit("  0"), lat, lon, F.floor("value"), F.lit("1006"), F.lit("TS"), F.lit("34"),
        F.when(F.col("event_id") % 3 == 0, F.lit("   ")).otherwise(F.lit("NEQ")), F.col("event_id"),
    )
    track = parse_best_track(e.select(F.concat(F.lit("s"), F.col("user_id")).alias("storm_id"), line.alias("value")))
    return track.select(
        F.col("radius_ne").cast("bigint").alias("event_id"), "storm_id", "basin", "storm_number",
        F.substring(F.col("ts").cast("string"), 1, 19).alias("at"),
        (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"), "max_wind", "quadrant",
    )


@check(
    """SELECT 's' || user_id AS storm_id, 'AL' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || year(min(ts)) AS storm_code FROM events GROUP BY user_id"""
)
def storm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id")).alias("storm_id"), F.lit("AL").alias("basin"),
        (F.col("user_id") % 100).cast("string").alias("storm_number"), "ts",
    )
    return storm_ids(track)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", ((e * 7) % 360 - 180).cast("double").alias("lon"), ((e * 3) % 179 - 89).cast("double").alias("lat")
    )


@check(
    """WITH p AS (SELECT user_id, event_id, radians(CAST((event_id * 7) % 360 - 180 AS DOUBLE)) AS x, radians(CAST((event_id * 3) % 179 - 89 AS DOUBLE)) AS y FROM events),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, CASE WHEN px IS NULL THEN 0 ELSE 2 * 6371000.0 * asin(least(1.0, sqrt(sin((y - py) / 2) ** 2 + cos(y) * cos(py) * sin((x - px) / 2) ** 2))) END AS step FROM l)
SELECT user_id, event_id, CAST(round(sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 1000) AS BIGINT) AS km FROM s"""
)
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths on a sphere, which plain SQL can check."""
    lengths = path_length(_points(spark, sf_dir), ["user_id"], ["event_id"], a=6371000.0, rf=0.0)
    return lengths.select("user_id", "event_id", F.round(F.col("length_m") / 1000).cast("bigint").alias("km"))


@check()
def ellipsoid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances on the ellipsoid; checked against known geodesics in the tests."""
    p = _points(spark, sf_dir)
    return p.select("event_id", ellipsoidal_distance(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat")).alias("metres"))


def _inverse_sql(steps: int = 12) -> str:
    """The inverse problem on WGS84 by a fixed number of iterations; start and end are never nearly antipodal."""
    parts = [
        """WITH g AS (SELECT event_id, 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f, radians((event_id * 7) % 150)::DOUBLE AS turn,
  radians((event_id * 5) % 121 - 60)::DOUBLE AS lat1, radians((event_id * 3) % 179 - 89)::DOUBLE AS lat2 FROM events),
u AS (SELECT *, atan((1 - f) * tan(lat1)) AS u1, atan((1 - f) * tan(lat2)) AS u2 FROM g),
i0 AS (SELECT *, turn AS l FROM u)"""
    ]
    for i in range(steps):
        parts.append(
            f"""s{i} AS (SELECT *, sqrt((cos(u2) * sin(l)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l)) ** 2) AS ss,
  sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) AS cs FROM i{i}),
a{i} AS (SELECT *, atan2(ss, cs) AS arc, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(l) / ss END AS sa FROM s{i}),
m{i} AS (SELECT *, CASE WHEN sa ** 2 = 1 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa ** 2) END AS mid,
  f / 16 * (1 - sa ** 2) * (4 + f * (4 - 3 * (1 - sa ** 2))) AS c FROM a{i}),
i{i + 1} AS (SELECT event_id, a, f, turn, u1, u2, ss AS ss_, cs AS cs_, arc AS arc_, sa AS sa_, mid AS mid_,
  turn + (1 - c) * f * sa * (arc + c * ss * (mid + c * cs * (-1 + 2 * mid ** 2))) AS l FROM m{i})"""
        )
    parts.append(
        f"""e AS (SELECT *, (1 - sa_ ** 2) * (1 / (1 - f) ** 2 - 1) AS k FROM i{steps}),
b AS (SELECT *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS ba, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM e),
d AS (SELECT *, bb * ss_ * (mid_ + bb / 4 * (cs_ * (-1 + 2 * mid_ ** 2) - bb / 6 * mid_ * (-3 + 4 * ss_ ** 2) * (-3 + 4 * mid_ ** 2))) AS ds FROM b)
SELECT event_id, CAST(round(a * (1 - f) * ba * (arc_ - ds) / 10) AS BIGINT) AS tens FROM d"""
    )
    return ",\n".join(parts)


@check(_inverse_sql())
def ellipsoid_tens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances on the ellipsoid in tens of metres, which a series in plain SQL can check away from the antipode."""
    e = F.col("event_id")
    lon, lat1, lat2 = (v.cast("double") for v in ((e * 7) % 150, (e * 5) % 121 - 60, (e * 3) % 179 - 89))
    metres = ellipsoidal_distance(F.lit(0.0), lat1, lon, lat2)
    return table(spark, sf_dir, "events").select("event_id", F.round(metres / 10).cast("bigint").alias("tens"))


_DOC_LINES = """docs AS (SELECT 'fort.' || doc_id AS rel_path, doc_id, lang, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS parts FROM documents),
ref AS (SELECT rel_path, doc_id, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no, unnest(parts) AS line, len(parts) AS n FROM docs WHERE lang <> 'de'),
test AS (SELECT rel_path, line_no, CASE WHEN line_no % 4 = 2 AND doc_id % 3 = 0 THEN line || '~' ELSE line END AS line, doc_id, lang,
                n FROM (SELECT rel_path, doc_id, lang, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no, unnest(parts) AS line, len(parts) AS n FROM docs)
         WHERE NOT (doc_id % 7 = 0 AND line_no = n))"""


@check(
    f"""WITH {_DOC_LINES}, lengths AS (SELECT rel_path, count(*) AS n FROM test GROUP BY 1)
SELECT coalesce(t.rel_path, r.rel_path) AS rel_path, coalesce(t.line_no, r.line_no) AS line_no, t.line AS test_line, r.line AS reference_line
FROM ref r FULL JOIN (SELECT * FROM test WHERE lang <> 'de') t ON t.rel_path = r.rel_path AND t.line_no = r.line_no
LEFT JOIN lengths l ON l.rel_path = coalesce(t.rel_path, r.rel_path)
WHERE t.line IS DISTINCT FROM r.line
  AND NOT (coalesce(t.rel_path, r.rel_path) LIKE '%fort.3%' AND l.n IS NOT NULL
           AND coalesce(t.line_no, r.line_no) - 1 IN (1 % l.n, l.n - 1))"""
)
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files against a changed copy: lines edited, last lines cut, files of one side only."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("fort."), F.col("doc_id")).alias("rel_path"), "doc_id", "text", "lang")
    lines = number_text_lines(docs, ["rel_path", "lang"])
    # the last line is cut from the text itself, so no line needs to know how many there are
    shortened = F.col("doc_id") % 7 == 0
    kept = docs.where(~shortened | F.col("text").rlike(r"[\n\r]")).withColumn(
        "text", F.when(shortened, F.regexp_extract("text", r"(?s)^(.*)(\r\n|\n|\r)[^\n\r]*\z", 1)).otherwise(F.col("text"))
    )
    edited = (F.col("line_no") % 4 == 2) & (F.col("doc_id") % 3 == 0)
    test = number_text_lines(kept, ["rel_path", "doc_id"]).withColumn(
        "line", F.when(edited, F.concat("line", F.lit("~"))).otherwise(F.col("line"))
    )
    return diff_trees(test, lines.where("lang <> 'de'"), {"fort.3": [1, -1]})


@check(
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'out_' || doc_id || '.nc' ELSE 'log_' || doc_id END AS rel_path, lang, n_chars FROM documents)
SELECT rel_path, CASE WHEN lang <> 'de' THEN n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END END AS test_length, n_chars AS reference_length
FROM f WHERE lang = 'de' OR (doc_id % 2 = 0 AND doc_id % 3 = 0)"""
)
def diff_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 2 == 0, F.concat(F.lit("out_"), d, F.lit(".nc"))).otherwise(F.concat(F.lit("log_"), d))
    docs = table(spark, sf_dir, "documents").select(d, name.alias("rel_path"), F.lit(False).alias("is_dir"), F.col("n_chars").alias("length"), "lang")
    longer = F.col("length") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return diff_sizes(docs.where("lang <> 'de'").withColumn("length", longer), docs)


@check(
    """WITH meshes AS (SELECT p_brand || s.copy AS mesh_id, p_partkey AS node_id,
           CASE WHEN p_brand IN ('Brand#3', 'Brand#4') AND s.copy = 'b' AND p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS size
         FROM part, (VALUES ('a'), ('b'), ('c')) s(copy)),
    texts AS (SELECT mesh_id, string_agg(node_id || ':' || size, ',' ORDER BY node_id, size) AS text FROM meshes GROUP BY mesh_id),
    classes AS (SELECT mesh_id, min(mesh_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS members FROM texts)
    SELECT * FROM classes"""
)
def classes_of_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's nodes as three meshes; two brands have one mesh whose nodes differ."""
    copies = F.explode(F.array(*map(F.lit, "abc"))).alias("copy")
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("node_id"), F.col("p_size").alias("size"), copies)
    moved = F.col("p_brand").isin("Brand#3", "Brand#4") & (F.col("copy") == "b") & (F.col("node_id") % 5 == 0)
    size = F.when(moved, F.col("size") + 1).otherwise(F.col("size"))
    meshes = rows.select(F.concat("p_brand", "copy").alias("mesh_id"), "node_id", size.alias("size"))
    return mesh_classes(meshes, ["node_id", "size"])

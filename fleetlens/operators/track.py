"""Storm tracks: clipping, storm codes and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import seconds_between
from ..functions.geodesic import WGS84_A, WGS84_RF, ellipsoidal_distance
from ..functions.names import storm_code
from ..session import pin
from .ordered import before_slice, cut_slices, on_slices


def clip_track(track: DataFrame, windows: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Track rows inside each run's window ``(config_dir, storm_id, start_ts, end_ts)``, ends included.

    Both sides are cut into time buckets and joined on (storm, bucket), so one long storm spreads
    over tasks and only rows near a window meet it. An open end reaches to the storm's own end.
    """
    span = track.groupBy("storm_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    closed = (
        windows.join(span, "storm_id")
        .withColumn("_from", F.greatest(F.coalesce("start_ts", "_first"), F.col("_first")))
        .withColumn("_to", F.least(F.coalesce("end_ts", "_last"), F.col("_last")))
        .where("_from <= _to")
    )

    def bucket(ts: str):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.floor(seconds_between(epoch, F.col(ts)) / bucket_seconds)

    spread = closed.select(
        "config_dir", "storm_id", "_from", "_to", F.explode(F.sequence(bucket("_from"), bucket("_to"))).alias("_bucket")
    )
    return (
        track.withColumn("_bucket", bucket("ts"))
        .join(spread, ["storm_id", "_bucket"])
        .where(F.col("ts").between(F.col("_from"), F.col("_to")))
        .select("config_dir", *track.columns)
    )


def storm_ids(track: DataFrame) -> DataFrame:
    """``(storm_id, storm_code)``: basin, number and start year of each track."""
    return track.groupBy("storm_id").agg(
        storm_code(F.min("basin"), F.min("storm_number"), F.year(F.min("ts"))).alias("storm_code")
    )


def path_length(
    points: DataFrame, keys: list[str], order: list[str], a: float = WGS84_A, rf: float = WGS84_RF
) -> DataFrame:
    """Add the distance from the point before (``step_m``) and the length so far (``length_m``).

    Points are sliced once. Steps inside a slice are taken and kept with it; the step over its edge and the length up to there
    come from one row per key and slice.
    """

    def metres(start: Column, end: Column) -> Column:
        step = ellipsoidal_distance(start["lon"], start["lat"], end["lon"], end["lat"], a, rf)
        return F.coalesce(step, F.lit(0.0))

    point = F.struct("lon", "lat")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_seq")
    cut = cut_slices(points, keys, [F.col(c) for c in order]).withColumn("_back", F.lag(point).over(inside))
    stepped = pin(cut.withColumn("step_m", metres(F.col("_back"), point)).drop("_back"))
    before = before_slice(keys)
    slices = (
        stepped.groupBy(*keys, "_slice")
        .agg(
            F.min("_seq").alias("_head"),
            F.min_by(point, "_seq").alias("_first"),
            F.max_by(point, "_seq").alias("_last"),
            F.sum("step_m").alias("_n"),
        )
        .withColumn("_prior", F.lag("_last").over(before))
        .withColumn("_gap", metres(F.col("_prior"), F.col("_first")))
        .withColumn(
            "_earlier",
            F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.sum("_gap").over(before),
        )
        .select(*keys, "_slice", "_head", "_gap", "_earlier")
    )
    upto = F.sum("step_m").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        on_slices(stepped, slices, keys)
        .withColumn("length_m", F.col("_earlier") + upto)
        .withColumn("step_m", F.when(F.col("_seq") == F.col("_head"), F.col("_gap")).otherwise(F.col("step_m")))
        .drop("_slice", "_seq", "_head", "_gap", "_earlier")
    )

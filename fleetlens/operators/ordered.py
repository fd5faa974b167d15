"""Ordered work inside groups that may be far larger than one task.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here rows are range
partitioned on (key, order), so a hot key is spread over many slices, each slice is worked
on its own, and only one summary row per key and slice is carried across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin


def cut_slices(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` sorted by (keys, order) with ``_slice`` (range partition) and ``_seq`` (sort position).

    Range bounds come from sampling, so a second evaluation could cut elsewhere: checkpoint before using it twice.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(slices, *by).sortWithinPartitions(*by)
    return ranged.withColumn("_slice", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())


def ordered_slices(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Checkpointed slices of ``df``."""
    return pin(cut_slices(df, keys, order))


def before_slice(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_slice")


def on_slices(sliced: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Attach each slice's summary; keys compare null-safe."""
    renamed = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"),
                             *[c for c in summary.columns if c not in keys and c != "_slice"])
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return sliced.join(renamed, same, "left").drop("_s", *[f"_k{i}" for i in range(len(keys))])


def rank_within(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Row number inside each key by ``order``."""
    sliced = ordered_slices(df, keys, order)
    summary = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
        .withColumn("_earlier", F.coalesce(F.sum("_n").over(before_slice(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    return (
        on_slices(sliced, summary, keys)
        .withColumn(name, F.col("_earlier") + F.col("_seq") - F.col("_first") + 1)
        .drop("_slice", "_seq", "_first", "_earlier")
    )


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to and including this one."""
    sliced = ordered_slices(df, keys, order)
    summary = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(value).alias("_n"))
        .withColumn("_earlier", F.sum("_n").over(before_slice(keys).rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        on_slices(sliced, summary, keys)
        .withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.coalesce(F.col("_earlier"), F.lit(0)))
        .drop("_slice", "_seq", "_earlier")
    )


def earlier_max(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Largest ``value`` of the rows before this one by ``order``; null on the first row."""
    sliced = ordered_slices(df, [], order)
    summary = (
        sliced.groupBy("_slice")
        .agg(F.max(value).alias("_n"))
        .withColumn("_earlier", F.max("_n").over(before_slice([]).rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_n")
    )
    inside = Window.partitionBy("_slice").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        on_slices(sliced, summary, [])
        .withColumn(name, F.greatest(F.max(value).over(inside), F.col("_earlier")))
        .drop("_slice", "_seq", "_earlier")
    )


def previous_values(df: DataFrame, keys: list[str], order: list, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """The columns of the row before this one inside its key; null on the first row."""
    sliced = ordered_slices(df, keys, order)
    held = F.struct(*columns)
    summary = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by(held, F.col("_seq")).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(before_slice(keys)))
        .drop("_tail")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_seq")
    back = (
        on_slices(sliced, summary, keys)
        .withColumn("_row", F.row_number().over(inside))
        .withColumn("_prev", F.when(F.col("_row") == 1, F.col("_carry")).otherwise(F.lag(held).over(inside)))
    )
    for column in columns:
        back = back.withColumn(prefix + column, F.col(f"_prev.{column}"))
    return back.drop("_slice", "_seq", "_carry", "_row", "_prev")


def last_wins(df: DataFrame, key: list[str], order) -> DataFrame:
    """One row per key: the one latest by ``order``. Partially aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*key, "_last.*")

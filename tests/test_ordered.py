"""Ordered work with a third of the rows in one key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.ordered import last_wins, ordered_slices, previous_values, rank_within, running_sum


def skewed(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        ((F.col("id") * 7919) % 3001).alias("o"),
        (F.col("id") % 11).alias("v"),
    )
    return rows.withColumn("k", F.when(F.col("o") == 5, F.lit(None)).otherwise(F.col("k")))


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_key_is_spread(spark):
    slices = ordered_slices(skewed(spark), ["k"], [F.col("o")]).where("k = 'hot'").select("_slice").distinct().count()
    assert slices > 1


def test_rank(spark):
    df = skewed(spark)
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o"))).select("k", "o", "r")
    assert pairs(rank_within(df, ["k"], [F.col("o")], "r").select("k", "o", "r")) == pairs(plain)


def test_running_sum(spark):
    df = skewed(spark)
    upto = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", "o", F.sum("v").over(upto).alias("s"))
    assert pairs(running_sum(df, ["k"], [F.col("o")], "v", "s").select("k", "o", "s")) == pairs(plain)


def test_previous(spark):
    df = skewed(spark)
    plain = df.select("k", "o", F.lag("v").over(Window.partitionBy("k").orderBy("o")).alias("prev_v"))
    assert pairs(previous_values(df, ["k"], [F.col("o")], ["v"]).select("k", "o", "prev_v")) == pairs(plain)


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, o int, v string")
    assert pairs(last_wins(df, ["k"], "o")) == [("a", 3, "y"), ("b", 1, None)]

"""Exact top-k by inner product: tiled matrix products of queries and shards.

Queries and candidates are dealt into tiles of bounded size, and every pair of a query tile with a candidate tile is one cell
of a grid. A cell multiplies its two matrices in blocks, keeps the best k of each query by partial selection, and
the lists of a query are merged in a tree, a few tiles at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query tile and of a candidate tile, and queries multiplied at a time.
QUERY_ROWS = 2048
SHARD_ROWS = 4096
BLOCK = 256
#: Lists merged at a time.
FAN_IN = 16
#: Integers that double precision holds.
EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector, copies``: each component x, as double, turned into floor(scale * x).

    Vectors that are null, or hold null or non-finite components, and rows without vec_id are left out. Rows that are equal then are
    one with their number in ``copies``. A vector without components is kept; its inner products are 0.
    """
    parts = F.col(vector_col).cast("array<double>")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.forall(parts, sound))
    whole = F.transform(parts, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    rows = good.select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("vector"))
    return rows.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as int64 rows; shorter ones are filled with zeros, which add nothing."""
    out = np.zeros((len(vectors), width), np.int64)
    for place, vector in enumerate(vectors):
        out[place, : len(vector)] = vector
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products, by floating point where every sum is a whole number that it holds."""
    bound = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0)) * left.shape[1]
    if bound < 1 << 24:
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int64)
    if bound < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def best(scores: np.ndarray, same: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of each row's k highest scores, ties to the smaller place, leaving out where ``same`` holds."""
    chosen = []
    for row, own in zip(scores, same):
        places = np.flatnonzero(~own)
        if len(places) > k:
            values = row[places]
            # everything above the k-th value, then the first places that equal it
            limit = np.partition(values, len(values) - k)[len(values) - k]
            above, equal = places[values > limit], places[values == limit]
            places = np.sort(np.concatenate([above, equal[: k - len(above)]]))
        chosen.append(places[np.argsort(-row[places], kind="stable")])
    return chosen


LIST = "query_id bigint, query_key bigint, query_copies bigint, vec_id bigint, score bigint, copies bigint, shard int"


def _cell(k: int):
    def work(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("query_id", "query_key", "query_copies", "vec_id", "score", "copies")}
        if len(queries) and len(shard):
            shard = shard.sort_values("other_id", kind="stable")
            width = max(queries["vector"].map(len).max(), shard["other"].map(len).max(), 1)
            ids, right = shard["other_id"].to_numpy(np.int64), _matrix(shard["other"], width)
            others, copies = shard["other"].tolist(), shard["other_copies"].to_numpy(np.int64)
            for at in range(0, len(queries), BLOCK):
                block = queries.iloc[at : at + BLOCK]
                own = block["vec_id"].to_numpy(np.int64)
                vectors = block["vector"].tolist()
                scores = _products(_matrix(block["vector"], width), right)
                # a query's own row is one of the copies of its vec_id and vector
                mine = own[:, None] == ids
                for i, j in zip(*np.nonzero(mine)):
                    mine[i, j] = np.array_equal(vectors[i], others[j])
                for i, places in enumerate(best(scores, mine & (copies == 1), k)):
                    out["vec_id"].append(ids[places])
                    out["score"].append(scores[i, places])
                    out["copies"].append(copies[places] - mine[i, places])
                    for name, value in (("query_id", own[i]), ("query_key", block["query_key"].iloc[i]), ("query_copies", block["copies"].iloc[i])):
                        out[name].append(np.full(len(places), value, np.int64))
        whole = {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in out.items()}
        number = int(shard["in_shard"].iloc[0]) if len(shard) else 0
        return pd.DataFrame(whole).assign(shard=number)

    return work


def _counted(vectors: DataFrame) -> DataFrame:
    """Rows with their number of copies, one each if it is not given."""
    if "copies" in vectors.columns:
        return vectors.select("vec_id", "vector", "copies")
    return vectors.groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best candidates, all if there are fewer.

    Both tables are ``vec_id, vector`` (and ``copies``, how often the row is there) as from ``integer_vectors``. Every row is a query or
    candidate of its own: a query's own row, which is one candidate with its vec_id and vector, is no match, its copies and other vectors under its
    vec_id are, and a query that is there twice has two lists. Ties go to the smaller vec_id. A product that a long cannot hold wraps
    around. Empty tables give an empty one.
    """
    queries, candidates = _counted(queries), _counted(candidates)
    tiles = lambda rows, size: max(1, math.ceil(rows.count() / size))
    n_queries, n_shards = tiles(queries, query_rows), tiles(candidates, shard_rows)
    # equal rows were made one, so a hash of the whole row deals out any group of copies
    key = F.xxhash64("vec_id", "vector")
    place = lambda n: F.pmod(key, F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "vector", "copies", key.alias("query_key"), place(n_queries).alias("tile")).withColumn("shard", every(n_shards))
    # names of their own: both sides may come from one table
    right = candidates.select(
        F.col("vec_id").alias("other_id"), F.col("vector").alias("other"), F.col("copies").alias("other_copies"), place(n_shards).alias("in_shard")
    )
    right = right.withColumn("for_tile", every(n_queries))
    lists = left.groupBy("tile", "shard").cogroup(right.groupBy("for_tile", "in_shard")).applyInPandas(_cell(k), LIST)
    query = ["query_id", "query_key"]
    while n_shards > 1:
        n_shards = math.ceil(n_shards / FAN_IN)
        lists = _merged(lists.withColumn("shard", F.expr(f"shard div {FAN_IN}").cast("int")), k, *query, "shard")
    # copies of a candidate take a rank each
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k).cast("bigint"))))
    whole = _merged(_merged(lists, k, *query).withColumn("copy", copy), k, *query)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), "query_copies"))
    return whole.select("query_id", "rank", "vec_id", "score", again.alias("copy")).drop("copy")


def _merged(lists: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return lists.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

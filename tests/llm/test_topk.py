import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm.topk import best, integer_vectors, top_k


def brute(rows, k, scale=64):
    """rows: (vec_id, vector); queries are ids that 20 divides. Every row is one of its own."""
    sound = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, (i, v) in enumerate(sound):
        if i % 20 == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(sound) if c != q]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k]))
    return out


@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_selection_with_ties(values, k):
    row = np.array(values, np.int64)
    own = np.array([i % 7 == 3 for i in range(len(values))], bool)
    wanted = sorted((i for i in range(len(values)) if not own[i]), key=lambda i: (-values[i], i))[:k]
    assert best(row[None], own[None], k)[0].tolist() == wanted


@pytest.mark.parametrize("sizes", [(2048, 4096), (3, 5)])
def test_against_brute_force(spark, sizes):
    rnd = random.Random(6)
    vector = lambda: [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]
    common = vector()
    rows = [(i, common if i % 3 == 0 else vector(), 1, "x") for i in range(130)]
    rows += [rows[20], rows[40], rows[40], *[rows[7]] * 30, (60, vector(), 1, "x"), (200, None, 1, "x"), (201, [1.0, None], 1, "x"), (220, [float("nan")] * 8, 1, "x"), (221, [float("inf")] * 8, 1, "x"), (None, vector(), 1, "x"), (240, [], 1, "x"), (241, [1.0], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int, score string")
    vectors = integer_vectors(table)
    got = top_k(vectors.where("vec_id % 20 = 0"), vectors, 20, *sizes)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == brute([r[:2] for r in rows], 20)
    assert top_k(vectors.limit(0), vectors, 20).count() == 0 and top_k(vectors, vectors.limit(0), 20).count() == 0


@pytest.mark.parametrize("size", [1.0, 3000.0, 2e6, 1e7])
def test_large_components_stay_exact(spark, size):
    rnd = random.Random(9)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(16)]) for i in range(45)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = integer_vectors(table)
    assert Counter(map(tuple, top_k(vectors.where("vec_id % 20 = 0"), vectors, 5).collect())) == brute(rows, 5)

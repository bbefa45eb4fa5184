import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.llm.topk import exact_scores, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, v int"


def brute(rows, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(64 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        mine = min(good[q])
        got = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, vs in good.items() for v in vs if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, [rng.gauss(0, .2) for _ in range(8)], "s", "r", 1) for i in range(300)]
    out += [(i, out[0][1], "s", "r", 1) for i in range(300, 420)]
    out += [(500, None, "s", "r", 1), (501, [None] * 8, "s", "r", 1), (520, [float("nan")] * 8, "s", "r", 1), (540, [float("inf")] * 8, "s", "r", 1),
            (560, [], "s", "r", 1), (561, [1.5, -2.0], "s", "r", 1), (None, [1.0] * 8, "s", "r", 1), (20, [0.1] * 8, "s", "r", 1), (7, [0.3] * 8, "s", "r", 1)]
    return out


@pytest.mark.parametrize("block_rows,sample_rows", [(2048, 2048), (64, 50), (100, 1)])
def test_equals_brute_force(ready_spark, rows, block_rows, sample_rows):
    df = ready_spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = top_k(df.where(F.col("vec_id") % 20 == 0), df, block_rows=block_rows, sample_rows=sample_rows, pivots=6)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_fewer_candidates_than_k(ready_spark):
    rows = [(0, [1.0, 2.0], "", "", 0), (1, [2.0, 1.0], "", "", 0)]
    df = ready_spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 64 * 128 * 2)]


def test_empty(ready_spark):
    df = ready_spark.createDataFrame([], SCHEMA)
    assert top_k(df, df).columns == ["query_id", "rank", "vec_id", "score"] and top_k(df, df).count() == 0


def test_large_components_stay_exact():
    a = np.array([[2.0 ** 40, 1.0]])
    assert exact_scores(a, np.array([2.0 ** 20, 3.0]))[0] == 2 ** 60 + 3

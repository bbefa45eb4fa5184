import numpy as np
import pytest

from timelens.operators import pair_gradients as pg


def brute(y, p, g, sigma):
    lam = np.zeros(len(y))
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] > y[j] and g[i] == g[j]:
                d = sigma * (y[i] - y[j]) / (1 + np.exp(min(700.0, sigma * (p[i] - p[j]))))
                lam[i] -= d
                lam[j] += d
    w = np.abs(lam) + 1
    return w / w.mean()


@pytest.mark.parametrize("spread,sigma,chunk", [(0.2, 1.0, 7), (3.0, 1.0, 16), (300.0, 1.0, 8), (5.0, 4.0, 512)])
def test_continuous_labels_match_all_pairs(spark, spread, sigma, chunk):
    rng = np.random.default_rng(int(spread))
    n = 150
    y, p, g = rng.normal(0, 2, n), rng.normal(0, spread, n), rng.integers(0, 3, n)
    y[:40], p[5:12], g[:40] = 0.5, 1.0, 0
    want = brute(y, p, g, sigma)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, p, g))], "id int, y double, p double, g int")
    got = {r["id"]: r["weight"] for r in pg.pair_weights(df, group="g", sigma=sigma, chunk=chunk).collect()}
    assert np.allclose([got[i] for i in range(n)], want, rtol=1e-9)


def test_rows_that_take_no_part(spark):
    rows = [(1, 0.0, 0.1, None), (2, 1.0, 0.2, None), (3, None, 0.2, "a"), (4, 1.0, None, "a"), (5, float("nan"), 1.0, "a"), (6, 1.0, float("inf"), "a"), (7, 2.0, 0.3, "a"), (7, 2.0, 0.3, "a")]
    df = spark.createDataFrame(rows, "id int, y double, p double, g string")
    got = pg.pair_weights(df, group="g").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 6, 7, 7]
    assert {r.id for r in got if r.weight is None} == {3, 4, 5, 6}
    assert pg.pair_weights(df.where("id < 0")).count() == 0

"""Predictive deviation against numpy, in a plan without a chain of array functions."""

import numpy as np
import pytest

from timelens.learn import ridge


def test_deviation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=80)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], [*names, "y"])
    m = ridge.fit_ridge(df, names)
    more = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 0.0), (float("nan"), 1.0, 1.0, 1.0, 0.0)], df.schema))
    rows = more.select(*names, m.deviation().alias("std"))
    got = rows.collect()
    for r in got[:80]:
        s = (np.array(r[:4]) - m.mean) / m.scale
        assert r["std"] == pytest.approx(np.sqrt(1 / m.alpha + s @ m.sigma @ s), rel=1e-9)
    assert got[80]["std"] is None and np.isnan(got[81]["std"])
    assert "zip_with" not in rows._jdf.queryExecution().toString()

"""Exact quantiles against numpy, with brackets small enough that every branch of the search runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.learn import ridge
from timelens.operators import reports
from timelens.operators.quantiles import _Target, exact_quantiles

FRACTIONS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def columns(n=3000):
    rng = np.random.default_rng(7)
    return {"normal": rng.normal(size=n), "heavy": rng.standard_cauchy(n) ** 3, "hot": np.where(np.arange(n) % 3 == 0, 5.0, rng.normal(size=n)),
            "halves": np.repeat([0.0, 1.0], n // 2), "five": rng.integers(0, 5, n).astype(float), "same": np.full(n, 2.5),
            "tiny": 1e-300 * rng.random(n), "count": rng.poisson(3, n).astype(float)}


@pytest.mark.parametrize("gather,accuracy", [(10_000, 10_000), (20, 50), (1, 10)])
def test_against_numpy(spark, gather, accuracy):
    data = columns()
    names = list(data)
    rows = [tuple(float(data[c][i]) for c in names) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(8)
    got = exact_quantiles(df, names, FRACTIONS, gather, accuracy)
    for c in names:
        assert got[c] == pytest.approx(list(np.quantile(data[c], FRACTIONS)), rel=1e-12, abs=1e-312), c


def test_nulls_empty_columns_and_names(spark):
    df = spark.createDataFrame([(1, None, 4.0), (None, None, float("nan")), (3, None, 2.0)], "`a b` int, gone double, c0 double")
    got = exact_quantiles(df, ["a b", "gone", "c0"], [0.0, 0.5, 1.0], gather=1)
    assert got["a b"] == [1.0, 2.0, 3.0] and got["gone"] == [None] * 3
    assert got["c0"][:2] == [2.0, 4.0] and np.isnan(got["c0"][2])
    assert exact_quantiles(df.limit(0), ["c0"], [0.5]) == {"c0": [None]}
    assert exact_quantiles(df, [], [0.5]) == {}


def test_a_guess_beside_the_rank_keeps_the_answer():
    """Values 0..99, rank 10, guessed at 50 and 60: the search goes on under 50; rank 90 goes on above 60."""
    low, high = _Target("x", 10, 100), _Target("x", 90, 100)
    for t in (low, high):
        t.narrow(50.0, 60.0, 50, 1, 9, 1)
    assert (low.low, low.high, low.rank, low.inside) == (None, 50.0, 10, 50)
    assert (high.low, high.high, high.rank, high.inside) == (60.0, None, 29, 39)


def test_reports_and_filling(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 9), ("c", 8), ("c", 7)], "author string, created_utc long")
    assert reports.dataset_stats(df).first()["median_posts"] == 2.0
    row = reports.describe(df, "created_utc").first()
    assert (row["q25"], row["q50"], row["q75"]) == (2.25, 5.0, 7.75)
    empty = reports.describe(df.limit(0), "created_utc").first()
    assert empty["count"] == 0 and empty["q50"] is None
    filled = ridge.median_filled(df.withColumn("x", F.when(F.col("author") != "c", F.col("created_utc")).cast("double")), ["x"])
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]

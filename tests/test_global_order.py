"""Global ranks and running sums over range partitions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from timelens.functions.skew import in_order, ranked, running_totals


def rows(n=600, seed=4):
    """A third of the rows share group and value; nulls in group and value."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, "hot", 5.0))
        else:
            out.append((i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), -1.0, 0.0, rng.random()])))
    return out


def sort_key(value):
    return (0, 0.0) if value is None else (2, 0.0) if value != value else (1, value)


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_ranked_by_group(spark, parts):
    data = rows()
    got = {r["id"]: r["n"] for r in ranked(spark.createDataFrame(data, "id int, g string, v double"), ["g"], "v", "id", "n", parts).collect()}
    want = {}
    for g in {r[1] for r in data}:
        for k, r in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: (sort_key(r[2]), r[0]))):
            want[r[0]] = k + 1
    assert got == want


@pytest.mark.parametrize("parts", [None, 5])
def test_ranked_without_group_gives_each_number_once(spark, parts):
    """Rows equal in order and tie still get numbers of their own."""
    df = spark.createDataFrame([(1.0, "x")] * 50 + [(0.0, "y")] * 50, "v double, t string").repartition(6)
    got = ranked(df, [], "v", "t", "n", parts).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 101))
    assert all((r["t"] == "y") == (r["n"] <= 50) for r in got)


@pytest.mark.parametrize("parts,chunk", [(None, 250_000), (1, 3), (6, 4), (30, 1)])
def test_running_totals(spark, parts, chunk):
    cells = {}
    for _, g, v in rows():
        key = (g, "nan" if v is not None and v != v else v)
        cells[key] = cells.get(key, 0) + 1
    data = [(g, float("nan") if v == "nan" else v, n) for (g, v), n in cells.items()]
    df = spark.createDataFrame(data, "g string, v double, n long")
    got = running_totals(df, ["g"], "v", ["n"], parts, chunk_rows=chunk).collect()
    assert len(got) == len(data)
    for r in got:
        assert r["before_n"] == sum(n for g, v, n in data if g == r["g"] and sort_key(v) < sort_key(r["v"]))


def test_hot_value_is_split(spark):
    """One value and tie on every row: the range bounds fall back on the task the rows come from."""
    df = spark.range(0, 8000, 1, 8).select(F.lit(1.0).alias("v"), F.lit("same").alias("t"))
    sizes = [r["count"] for r in in_order(df, ["v", "t"], 8).groupBy("_slice").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2000


def test_empty(spark):
    df = spark.createDataFrame([], "id int, g string, v double, n long")
    assert ranked(df, ["g"], "v", "id").count() == 0
    assert running_totals(df, ["g"], "v", ["n"]).count() == 0

"""Bootstrap against a plain run that draws every row in every replicate."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from timelens.learn import resample

P = 2**31 - 1
CUT = [math.ceil(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * P) for k in range(16)]


def draws(key, n, seed=42):
    d = hashlib.md5(f"{key}:{seed}".encode()).hexdigest()
    c = [int(d[8 * i:8 * i + 8], 16) % P for i in range(4)]
    out = []
    for r in range(1, n + 1):
        u = c[0]
        for x in c[1:]:
            u = (u * r % P + x) % P
        out.append(sum(u >= t for t in CUT))
    return out


def auc(pairs):
    """Weighted AUC by all pairs."""
    pos, neg = [(s, w) for s, h, w in pairs if h and w], [(s, w) for s, h, w in pairs if not h and w]
    total = sum(w for _, w in pos) * sum(w for _, w in neg)
    return sum(a * b * (1.0 if x > y else 0.5 if x == y else 0.0) for x, a in pos for y, b in neg) / total if total else None


@pytest.mark.parametrize("parts,hot", [(1, False), (7, False), (7, True)])
def test_replicate_auc(spark, parts, hot):
    """Also where one score, which may lie in many tasks, holds most rows."""
    rng = random.Random(parts)
    rows = [(i, rng.choice("ab") if i else "b", c, 0.5 if hot and rng.random() < 0.8 else rng.choice([0.1, 0.25, 0.5, 0.75, rng.random()])) for i in range(120) for c in "ab"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "id long, label string, class string, score double").repartition(5)
        got = {(r["class"], r.replicate): r.auc for r in resample.replicate_auc(df, 40).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    w = {i: draws(i, 40) for i in range(120)}
    for c in "ab":
        for r in range(40):
            assert got[c, r] == pytest.approx(auc([(s, lab == c, w[i][r]) for i, lab, k, s in rows if k == c]), abs=1e-12)


def test_one_sided_replicates_have_no_auc(spark):
    df = spark.createDataFrame([(i, "a", "a", i / 9) for i in range(9)], "id long, label string, class string, score double")
    assert {r.auc for r in resample.replicate_auc(df, 10).collect()} == {None}


def test_weighted_cells(spark, monkeypatch):
    """Sums of every group and replicate, also where a task must hand groups on early."""
    monkeypatch.setattr(resample, "HELD", 2000)
    rng = random.Random(2)
    rows = [(i, rng.choice("xyz"), rng.choice([None, "q"]), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, h string, v double").repartition(4)
    want: dict = defaultdict(lambda: [0.0, 0.0])
    for i, g, h, x in rows:
        for r, w in enumerate(draws(i, 60)):
            if w:
                want[g, h, r][0] += w
                want[g, h, r][1] += w * x
    got = {(r.g, r.h, r.replicate): [r.w, r.v] for r in resample.weighted_cells(df, ["g", "h"], ["v"], "id", 60).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_draws_are_poisson(spark):
    w = [x for i in range(500) for x in draws(i, 40)]
    mean = sum(w) / len(w)
    assert abs(mean - 1) < 0.03 and abs(sum((x - mean) ** 2 for x in w) / len(w) - 1) < 0.06


def test_draws_are_folded_not_divided():
    """The remainder modulo the prime is taken exactly, at its edges too, and weights are bytes."""
    import numpy as np
    edge = [0, 1, P - 2, P - 1]
    c = np.array([[a, b, x, y] for a in edge for b in edge for x in edge for y in (0, P - 1)] + [[17 * i * i % P, 99 * i, P - 3 * i, 12345 * i % P] for i in range(1, 200)], np.int64).T
    got = resample.drawer(90)([*c])
    assert got.dtype == np.int8
    for row, have in zip(c.T.tolist(), got.tolist()):
        want = []
        for r in range(1, 91):
            u = row[0]
            for x in row[1:]:
                u = (u * r % P + x) % P
            want.append(sum(u >= t for t in CUT))
        assert have == want

"""Many models in shared passes against plain fits one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.learn import many
from timelens.learn.folds import CLASSES

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        y = rng.choice([0, 1, 1, 1, 2])
        rows.append((f"u{i}", CLASSES[y], i % 5, rng.gauss(y, 1), rng.gauss(0, 2) if i % 7 else None, rng.gauss(-y, 3)))
    return spark.createDataFrame(rows, "author string, label string, fold int, a double, b double, c double").repartition(4)


def newton(x, y, w, penalty):
    """Multinomial logistic regression by full Newton steps."""
    k, d = len(CLASSES), x.shape[1]
    coef, ridge = np.zeros((d, k)), np.diag([0.0] + [penalty] * (d - 1))
    one = np.eye(k)[y]
    for _ in range(100):
        z = x @ coef
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (w[:, None] * (p - one)) + ridge @ coef
        h = np.zeros((d * k, d * k))
        for i in range(k):
            for j in range(k):
                h[i * d:(i + 1) * d, j * d:(j + 1) * d] = x.T @ ((w * p[:, i] * ((i == j) - p[:, j]))[:, None] * x) + (ridge if i == j else 0)
        step = np.linalg.lstsq(h, g.T.ravel(), rcond=None)[0].reshape(k, d).T
        coef -= step
        if np.abs(step).max() < 1e-12:
            break
    return coef


def plain(design, response, rows):
    """Scores of every row by a model that has not seen it, and its slot."""
    x = np.array([[1.0, *r["_x"]] for r in rows])
    own = np.array([r["_y"] * 5 + r["fold"] for r in rows])
    pos = np.array([r["_pos"] for r in rows])
    ends = np.cumsum(design.n_slots.ravel())
    slot = own if response.shuffle is None else np.searchsorted(ends, many.shuffler(len(rows), design.seed)(pos, response.shuffle), "right")
    y, fold = slot // 5, slot % 5
    scores = np.zeros((len(rows), 3))
    for f in range(5):
        train = fold != f
        n_c = np.bincount(y[train], minlength=3)
        coef = newton(x[train], y[train], 1 / (3 * n_c[y[train]]), 1 / (response.c * train.sum()))
        z = x[~train] @ coef
        p = np.exp(z - z.max(1, keepdims=True))
        scores[~train] = p / p.sum(1, keepdims=True)
    return y, scores


def auc_at_steps(y, scores):
    out = []
    for c in range(3):
        s = np.minimum(np.floor(scores[:, c] * many.STEPS), many.STEPS - 1)
        p, n = s[y == c], s[y != c]
        out.append(((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n)))
    return float(np.mean(out))


def test_every_model_is_that_of_a_single_fit(data):
    design = many.Design(data, FEATURES)
    rows = design.rows.collect()
    responses = [many.Response(c=0.5), many.Response(c=3.0), many.Response(0, 0.5), many.Response(1, 0.1)]
    w = design.fit(responses, tol=1e-10, max_iter=600)
    got = {r.response: r.auc for r in design.aucs(responses, w).collect()}
    for j, response in enumerate(responses):
        y, scores = plain(design, response, rows)
        x = np.array([[1.0, *r["_x"]] for r in rows])
        for i in range(0, len(rows), 11):
            near = min(np.abs(np.exp(x[i] @ w[j, f]) / np.exp(x[i] @ w[j, f]).sum() - scores[i]).max() for f in range(5))
            assert near < 1e-6
        assert got[j] == pytest.approx(auc_at_steps(y, scores), abs=2e-3)


def test_permutation_test_against_plain_run(data):
    """Observed value, null distribution and p value of one-by-one fits."""
    design = many.Design(data, FEATURES)
    rows = design.rows.collect()
    want = [auc_at_steps(*plain(design, many.Response(i, 0.5), rows)) for i in [None, *range(12)]]
    got = many.permutation_test(data, FEATURES, 12).first()
    assert got.observed == pytest.approx(want[0], abs=2e-3) and got.null_mean == pytest.approx(np.mean(want[1:]), abs=2e-3)
    assert got.p_value == (1 + sum(x >= want[0] for x in want[1:])) / 13 and got.permutations == 12


def test_penalty_search_orders_as_single_fits(data):
    cs = [0.01, 0.3, 10.0]
    design = many.Design(data, FEATURES)
    rows = design.rows.collect()
    want = {c: auc_at_steps(*plain(design, many.Response(c=c), rows)) for c in cs}
    got = many.penalty_search(data, FEATURES, cs).collect()
    assert [r.auc for r in got] == sorted([r.auc for r in got], reverse=True)
    for r in got:
        assert r.auc == pytest.approx(want[r.c], abs=2e-3)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_shuffles_are_bijections(n):
    shuffle = many.shuffler(n, 42)
    seen = {tuple(shuffle(np.arange(n), r).tolist()) for r in range(20)}
    assert all(sorted(s) == list(range(n)) for s in seen) and (n < 17 or len(seen) == 20)


def test_permuted_pairs_keep_the_counts(data):
    design = many.Design(data, FEATURES)
    ends = np.cumsum(design.n_slots.ravel())
    for r in range(3):
        slots = np.searchsorted(ends, many.shuffler(90, design.seed)(np.arange(90), r), "right")
        assert (np.bincount(slots, minlength=15) == design.n_slots.ravel()).all()
    assert data.where(F.col("fold") == 0).count() == design.n_slots[:, 0].sum()


def test_settled_responses_are_left_alone(data, monkeypatch):
    """Passes take only the responses that still move."""
    design, seen = many.Design(data, FEATURES), []
    sums = design._sums

    def counted(responses, *rest):
        seen.append(len(responses))
        return sums(responses, *rest)

    monkeypatch.setattr(design, "_sums", counted)
    responses = [many.Response(c=3.0), *[many.Response(i, 1e-4) for i in range(6)]]
    w = design.fit(responses)
    assert min(seen[1:]) < 7 and len(w) == 7
    for j in (0, 3):
        assert np.abs(w[j] - design.fit([responses[j]])[0]).max() < 2e-3

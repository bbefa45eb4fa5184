"""Borders of many series at once against one by one."""

import time

import numpy as np
import pytest

from timelens.operators import changepoint


def series(rng, n):
    x = rng.normal(size=n) + np.repeat(rng.normal(scale=4, size=n // 20 + 1), 20)[:n]
    return np.round(x, 1) if rng.random() < 0.3 else x


@pytest.mark.parametrize("penalty,min_segment,jump", [(3.0, 2, 1), (3.0, 3, 5), (0.5, 7, 2), (1.0, 1, 4)])
def test_borders_are_those_of_each_series(penalty, min_segment, jump):
    rng = np.random.default_rng(8)
    rows = [series(rng, int(n)) for n in rng.integers(0, 90, 150)] + [np.zeros(40), np.full(30, np.nan), np.r_[np.ones(9), np.nan, np.ones(20)]]
    want = [changepoint.segment(r, penalty, min_segment, jump) for r in rows]
    assert changepoint.segmenter(penalty, min_segment, jump)(rows) == want
    assert changepoint.segmenter(penalty, min_segment, jump)(rows, at_once=100) == want and sum(map(len, want)) > 100


def test_many_series_take_a_fraction_of_the_time():
    rng = np.random.default_rng(9)
    rows = [series(rng, 340) for _ in range(40)]
    t = time.perf_counter()
    one = [changepoint.segment(r, 3.0, 2, 1) for r in rows]
    u = time.perf_counter()
    assert changepoint.segmenter(3.0, 2, 1)(rows) == one and time.perf_counter() - u < (u - t) / 2

"""The change-point pipeline counts the users that the operator's own minimum leaves."""

import os

import __spark_entry__ as entry
from timelens.constants import CP_MIN_WEEKS
from timelens.plans import series_q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_default_minimum(spark):
    rows = {r.label: r for r in entry.queries()["change_point_pipeline"](spark, SF).collect()}
    weeks = [r["count"] for r in series_q.order_series(spark, SF).groupBy("author").count().collect()]
    long = [n for n in weeks if n >= CP_MIN_WEEKS]
    assert long and rows["all"].n_users == len(long)
    assert abs(rows["all"].mean_weeks - sum(long) / len(long)) < 1e-6  # rounded to six places

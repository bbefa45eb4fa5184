"""Registry of end-to-end queries with their SQL cross-checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}

DIGITS = 6
# Added before rounding so that exact decimal ties, which two engines may reach from either
# side by the last bit, round the same way.
NUDGE = 3e-10


def rounded(df: DataFrame) -> DataFrame:
    """Round every double to six places so two engines can be compared by value."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`") + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def rounded_sql(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    items = ", ".join(f'round(CAST("{c}" AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({items}) FROM (\n{sql}\n)"


def query(name: str, rows: str, sql: str | None = None, doubles: str | list[str] = ""):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``rows`` lists the inventory rows it covers."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        ROWS[name] = rows
        if sql:
            cols = doubles.split() if isinstance(doubles, str) else list(doubles)
            ORACLES[name] = rounded_sql(sql, cols)
        return fn
    return wrap

"""What the operators of this package share: registry, text access inside tasks, worker set-up."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Bytes of text that one step inside a task works on at a time.
STEP_BYTES = 4 << 20


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with DuckDB SQL for its rows where there is any."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ready(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def ready(spark: SparkSession) -> None:
    """Let Python workers import this repository even if the session was started elsewhere."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def byte_list(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of an Arrow column; a null text is empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary()).to_pylist()]


def text_list(col: pa.Array) -> list[str]:
    """Every text of an Arrow column; a null text is empty."""
    return ["" if x is None else x for x in col.to_pylist()]


def sizes(col: pa.Array) -> list[int]:
    """Bytes of every text of an Arrow column."""
    return pc.fill_null(pc.binary_length(col), 0).to_pylist()


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single longer row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

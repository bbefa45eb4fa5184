"""Exact quantiles of many columns by distributed selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Values of a bracket that are few enough to be read off a sorted array.
GATHER = 10_000


class _Target:
    """One wanted rank of a column: it lies among the ``inside`` values strictly between ``low`` and ``high``."""

    def __init__(self, column: str, rank: int, n: int):
        self.column, self.rank, self.inside = column, rank, n  # rank counts from the first value of the bracket
        self.low = self.high = self.value = None
        self.open = True

    def bracketed(self) -> Column:
        c = F.col(self.column)
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (c > self.low)
        if self.high is not None:
            keep = keep & (c < self.high)
        return keep

    def found(self, value: float) -> None:
        self.value, self.open = value, False

    def narrow(self, a: float, b: float, under: int, at_a: int, between: int, at_b: int) -> None:
        """Move to the part that holds the rank; ``a`` and ``b`` need not enclose it, so a poor guess costs only a round."""
        r = self.rank
        if r < under:
            self.high, self.inside = a, under
        elif r < under + at_a:
            self.found(a)
        elif r < under + at_a + between:
            self.low, self.high, self.rank, self.inside = a, b, r - under - at_a, between
        elif r < under + at_a + between + at_b:
            self.found(b)
        else:
            passed = under + at_a + between + at_b
            self.low, self.rank, self.inside = b, r - passed, self.inside - passed


def exact_quantiles(df: DataFrame, columns: list[str], fractions: list[float], gather: int = GATHER,
                    accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation of every column, as ``{column: [value per fraction]}``; None without values.

    The columns are written once as doubles (whole numbers beyond 2^53 lose their last digits). A sketch proposes two
    values around each wanted rank, a second pass counts exactly what lies under, at and between them, and the search
    goes on strictly inside: some 5,000 times fewer values a round, all columns in the same passes. At most ``gather``
    values of a bracket are then sorted. Nulls do not count, NaN is the largest value, and a value that fills a third of the rows ends its
    search at once. The sketch steers only the number of rounds. The driver holds a few numbers a column and fraction.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    spark_names = {c: f"c{i}" for i, c in enumerate(columns)}
    table = materialize(df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in spark_names.items()]), "quantile_columns")
    counts = table.agg(*[F.count(n).alias(n) for n in spark_names.values()]).first()
    targets: dict[tuple[str, int], _Target] = {}
    for n in spark_names.values():
        for p in fractions:
            at = p * (counts[n] - 1)
            for rank in {math.floor(at), math.ceil(at)} if counts[n] else ():
                targets.setdefault((n, rank), _Target(n, rank, counts[n]))

    while live := [t for t in targets.values() if t.open]:
        large = [t for t in live if t.inside > gather]
        small = [t for t in live if t.inside <= gather]
        margin = 2.0 / accuracy
        aggs = [F.get(F.sort_array(F.collect_list(F.when(t.bracketed(), F.col(t.column)))), F.lit(t.rank)).alias(f"v{i}")
                for i, t in enumerate(small)]
        aggs += [F.percentile_approx(F.when(t.bracketed(), F.col(t.column)),
                                     [max(0.0, t.rank / t.inside - margin), min(1.0, (t.rank + 1) / t.inside + margin)],
                                     accuracy).alias(f"s{i}") for i, t in enumerate(large)]
        row = table.agg(*aggs).first()
        for i, t in enumerate(small):
            t.found(row[f"v{i}"])
        if not large:
            continue
        guesses = [row[f"s{i}"] for i in range(len(large))]
        aggs = []
        for i, (t, (a, b)) in enumerate(zip(large, guesses)):
            c, keep = F.col(t.column), t.bracketed()
            aggs += [F.count_if(keep & (c < a)).alias(f"u{i}"), F.count_if(keep & (c == a)).alias(f"a{i}"),
                     F.count_if(keep & (c > a) & (c < b)).alias(f"m{i}"), F.count_if(keep & (c > a) & (c == b)).alias(f"b{i}")]
        row = table.agg(*aggs).first()
        for i, (t, (a, b)) in enumerate(zip(large, guesses)):
            t.narrow(a, b, row[f"u{i}"], row[f"a{i}"], row[f"m{i}"], row[f"b{i}"])

    out: dict[str, list[float | None]] = {}
    for c, n in spark_names.items():
        out[c] = []
        for p in fractions:
            if not counts[n]:
                out[c].append(None)
                continue
            at = p * (counts[n] - 1)
            lo, hi = targets[n, math.floor(at)].value, targets[n, math.ceil(at)].value
            out[c].append(lo if lo == hi else lo + (at - math.floor(at)) * (hi - lo))
    return out

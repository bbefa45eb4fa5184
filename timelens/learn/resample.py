"""Bootstrap over count cells: every cell carries one array with its weight in each replicate.

A row's draws come from a random polynomial whose four coefficients are taken from a digest of the row's key, so any task can
make them again and draws of up to four replicates are independent. Weights of a row's replicates are added up inside the task; what
is shuffled is one array a cell and task, never a row a replicate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SEED
from ..operators import metrics

#: Draws are uniform on 0 .. PRIME - 1.
PRIME = 2**31 - 1
TOP = 16
#: A draw counts one for each of these it reaches: Poisson(1) by inversion.
REACHED = [math.ceil(sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) * PRIME) for k in range(TOP)]
#: Replicates of one piece of a cell's array, array elements that a task draws at once, and bytes of sums that it holds.
PIECE, AT_ONCE, HELD = 250, 1 << 20, 64 << 20
#: Draws whose arithmetic stays in a core's cache.
DRAWN = 1 << 15


def coefficients(key: str, seed: int = SEED) -> list[Column]:
    """Four numbers below ``PRIME`` from the digest of a row's key."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return [(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME).alias(f"_c{i}") for i in range(4)]


def drawer(n_boot: int):
    """Function from four coefficient arrays to the (rows, replicates) weights; it carries all it needs to a task."""
    at, reached, prime, block = np.arange(1, n_boot + 1, dtype=np.uint64), list(REACHED), np.uint64(PRIME), max(1, DRAWN // max(1, n_boot))

    def draw(c: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(c[0]), len(at)), np.int8)
        for a in range(0, len(out), block):
            part = slice(a, a + block)
            u = np.repeat(c[0][part][:, None].astype(np.uint64), len(at), 1)
            for x in c[1:]:
                u *= at
                u += x[part][:, None].astype(np.uint64)
                # 2^31 is 1 modulo the prime: a fold keeps the remainder.
                high = u >> np.uint64(31)
                u &= prime
                u += high
                if n_boot >= 1 << 20:
                    high = u >> np.uint64(31)
                    u &= prime
                    u += high
            # Below twice the prime; one less than 0 would be a very large number.
            high = u >> np.uint64(31)
            u &= prime
            u += high
            low, w = np.minimum(u, u - prime).astype(np.int32), out[part]
            for limit in reached:
                more = low >= limit
                if not more.any():
                    break
                w += more
        return out
    return draw


def poisson_one(u: Column, top: int = TOP) -> Column:
    """Poisson(1) count of a uniform draw in [0, 1) by inversion."""
    out = F.lit(0)
    for limit in REACHED[:top]:
        out = out + F.when(u >= limit / PRIME, 1).otherwise(0)
    return out


def weighted_cells(rows: DataFrame, group: list[str], values: list[str], key: str, n_boot: int, seed: int = SEED) -> DataFrame:
    """``(group, replicate, w, <value>...)``: weight and weighted sums of every group in every replicate that drew it.

    A task adds up its rows by group and hands on one array a group and ``PIECE`` replicates; groups beyond ``HELD`` bytes are handed on
    early. Arrays of a group are added piece by piece, so one group is spread over ``n_boot / PIECE`` tasks.
    """
    draw, n_values, width = drawer(n_boot), len(values), 1 + len(values)
    step, limit, piece = max(1, AT_ONCE // n_boot), HELD, PIECE
    keyed = rows.select(F.to_json(F.struct(*group)).alias("_g"), *coefficients(key, seed), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for g, s in sums.items():
                parts = range(0, n_boot, piece)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(parts)), pa.array([a // piece for a in parts], pa.int32()),
                                                  pa.array([s[:, a:a + piece].tobytes() for a in parts], pa.binary())], names=["_g", "_p", "_s"])

        for batch in batches:
            names, c = batch.column(0).to_pylist(), [batch.column(1 + i).to_numpy() for i in range(4)]
            v = [batch.column(5 + i).to_numpy() for i in range(n_values)]
            for a in range(0, len(names), step):
                part = slice(a, a + step)
                w = draw([x[part] for x in c])
                place = {g: i for i, g in enumerate(dict.fromkeys(names[part]))}
                at = np.array([place[g] for g in names[part]])
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(len(place)))
                w = w[order].astype(float)
                made = [np.add.reduceat(w, cuts, 0)] + [np.add.reduceat(w * x[part][order][:, None], cuts, 0) for x in v]
                for g, i in place.items():
                    new = np.stack([m[i] for m in made])
                    sums[g] = sums[g] + new if g in sums else new
                if len(sums) * n_boot * width * 8 > limit:
                    yield from out()
                    sums.clear()
        yield from out()

    def add(table: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x, float) for x in table["_s"].to_pylist()).reshape(width, -1)
        first = table["_p"][0].as_py() * piece
        hit = np.flatnonzero(s[0] > 0)
        return pa.table({"_g": pa.array([table["_g"][0].as_py()] * len(hit)), "replicate": pa.array(first + hit, pa.int32()), "w": pa.array(s[0][hit]),
                         **{f"_v{i}": pa.array(s[1 + i][hit]) for i in range(n_values)}})

    made = keyed.mapInArrow(run, "_g string, _p int, _s binary")
    cols = ", ".join(f"_v{i} double" for i in range(n_values))
    done = made.groupBy("_g", "_p").applyInArrow(add, f"_g string, replicate int, w double{', ' + cols if cols else ''}")
    schema = rows.select(*group).schema
    return done.withColumn("_g", F.from_json("_g", schema)).select("_g.*", "replicate", "w", *[F.col(f"_v{i}").alias(v) for i, v in enumerate(values)])


def replicate_auc(scores: DataFrame, n_boot: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """``(class, replicate, auc)`` from ``(key, label, class, score)``; null where a replicate has one side only.

    Rows are dealt by ranges of (class, score). A task walks its scores upwards with running weights and hands on, for each class, the sum of
    its inner scores and its two outermost scores, which may go on in the next task. These few arrays are joined in order.
    """
    draw, step, piece = drawer(n_boot), max(1, AT_ONCE // n_boot), PIECE
    hit = F.coalesce(F.col("label") == F.col("class"), F.lit(False))
    rows = (scores.where(F.col("score").isNotNull())
            .select("class", F.col("score").cast("double").alias("score"), hit.cast("long").alias("hit"), *coefficients(key, seed))
            .repartitionByRange("class", "score", "_c0", "_c1").sortWithinPartitions("class", "score"))

    def run(batches):
        """Cells arrive in order; the last one of a step waits for the next step."""
        state: dict = {"class": None}

        def records():
            c = state["class"]
            if c is None:
                return
            kinds = [("first", state["low"], state["low"])] if state["first"] is not None else []
            if state["n"]:
                kinds.append(("inner", state["inner_low"], state["inner_high"]))
            kinds.append(("last", state["score"], state["score"]))
            for kind, low, high in kinds:
                a, p, n = (None, *state["first"]) if kind == "first" else (state["auc"], state["pos"], state["neg"]) if kind == "inner" else (None, *state["open"])
                for at in range(0, n_boot, piece):
                    part = slice(at, at + piece)
                    yield c, at // piece, low, high, (np.zeros(0) if a is None else a[part]).tobytes(), p[part].tobytes(), n[part].tobytes()

        def close():
            """The open cell is complete: the first of its class is kept apart, the others are added to the inner sum."""
            pos, neg = state["open"]
            if state["first"] is None:
                state["first"], state["low"] = (pos, neg), state["score"]
                return
            if not state["n"]:
                state["inner_low"] = state["score"]
            state["inner_high"] = state["score"]
            state["auc"] = state["auc"] + pos * (state["neg"] + neg / 2)
            state["pos"], state["neg"], state["n"] = state["pos"] + pos, state["neg"] + neg, state["n"] + 1

        def begin(c):
            z = np.zeros(n_boot)
            state.update({"class": c, "first": None, "n": 0, "auc": z, "pos": z, "neg": z, "score": None, "open": None})

        def batch_of(rows_):
            cols = list(zip(*rows_))
            types = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["class", "piece", "low", "high", "auc", "pos", "neg"])

        for batch in batches:
            cls, score, hits = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            c = [batch.column(3 + i).to_numpy() for i in range(4)]
            for a in range(0, len(cls), step):
                part = slice(a, a + step)
                w, h, s = draw([x[part] for x in c]).astype(float), hits[part][:, None], score[part]
                names = cls[part]
                new = np.array([i == 0 or names[i] != names[i - 1] or s[i] != s[i - 1] for i in range(len(names))])
                cuts = np.flatnonzero(new)
                pos, neg = np.add.reduceat(w * h, cuts, 0), np.add.reduceat(w, cuts, 0)
                neg -= pos
                for k, i in enumerate(cuts.tolist()):
                    if names[i] != state["class"]:
                        done = list(records())
                        if done:
                            yield batch_of(done)
                        begin(names[i])
                    elif s[i] == state["score"]:
                        state["open"] = (state["open"][0] + pos[k], state["open"][1] + neg[k])
                        continue
                    else:
                        close()
                    state["score"], state["open"] = float(s[i]), (pos[k], neg[k])
        done = list(records())
        if done:
            yield batch_of(done)

    def join(table: pa.Table) -> pa.Table:
        total = below = hits = None
        score, open_ = None, None

        def closed():
            nonlocal total, below, hits
            if open_ is not None:
                pos, neg = open_
                total, below, hits = total + pos * (below + neg / 2), below + neg, hits + pos

        order = sorted(zip(*[table[n].to_pylist() for n in ("low", "high", "auc", "pos", "neg")]), key=lambda r: (r[0], r[1]))
        for low, _, auc, pos, neg in order:
            pos, neg = np.frombuffer(pos), np.frombuffer(neg)
            if total is None:
                total, below, hits = (np.zeros(len(pos)) for _ in range(3))
            if auc:
                closed()
                total, below, hits, open_, score = total + np.frombuffer(auc) + pos * below, below + neg, hits + pos, None, None
            elif low == score:
                open_ = open_[0] + pos, open_[1] + neg
            else:
                closed()
                score, open_ = low, (pos, neg)
        closed()
        base = hits * below
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(base > 0, total / base, np.nan)
        first = table["piece"][0].as_py() * piece
        return pa.table({"class": pa.array([table["class"][0].as_py()] * len(value)), "replicate": pa.array(first + np.arange(len(value)), pa.int32()),
                         "auc": pa.array(value, mask=~(base > 0))})

    made = rows.mapInArrow(run, "class string, piece int, low double, high double, auc binary, pos binary, neg binary")
    return made.groupBy("class", "piece").applyInArrow(join, "class string, replicate int, auc double")


def summary(values: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation and percentile interval over replicates, and how many were degenerate."""
    aggs = [F.count(F.lit(1)).alias("replicates")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.percentile(c, F.lit(0.025)).alias(f"{c}_low"),
                 F.percentile(c, F.lit(0.975)).alias(f"{c}_high"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_degenerate")]
    return values.groupBy(*(group or [])).agg(*aggs)


def replicate_metrics(scores: DataFrame, n_boot: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """Macro AUC and macro F1 of every replicate from ``(key, label, class, score)``.

    Draws depend on the row key, so all classes of a row share one multiplicity.
    """
    auc = metrics.macro_auc(replicate_auc(scores, n_boot, seed, key), ["replicate"])
    pred = weighted_cells(metrics.argmax_class(scores, [key]), ["label", "prediction"], [], key, n_boot, seed)
    f1 = metrics.averages(metrics.per_class(pred, ["replicate"], weight="w"), ["replicate"]).select(
        "replicate", F.col("macro_f1").alias("f1"))
    return auc.join(f1, "replicate")


def bootstrap_metrics(scores: DataFrame, n_boot: int, seed: int = SEED, key: str = "id") -> DataFrame:
    return summary(replicate_metrics(scores, n_boot, seed, key), ["auc", "f1"])


def paired_bootstrap(a: DataFrame, b: DataFrame, n_boot: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """Difference of macro AUC under shared draws, with one- and two-sided p values."""
    def aucs(s, name):
        return metrics.macro_auc(replicate_auc(s, n_boot, seed, key), ["replicate"]).withColumnRenamed("auc", name)
    d = aucs(a, "auc_a").join(aucs(b, "auc_b"), "replicate").withColumn("delta", F.col("auc_a") - F.col("auc_b"))
    one = F.avg((F.col("delta") <= 0).cast("double"))
    return d.agg(F.count("delta").alias("replicates"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta"),
                 F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"),
                 one.alias("p_one"), (2 * F.least(one, 1 - one)).alias("p_two"))


def bootstrap_group_means(long: DataFrame, group: list[str], value: str, key: str, n_boot: int, seed: int = SEED) -> DataFrame:
    """Percentile interval of the mean per group; one value gives itself twice."""
    rows = long.filter(F.col(value).isNotNull()).select(*group, key, value)
    base = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    means = weighted_cells(rows, group, [value], key, n_boot, seed).select(*group, (F.col(value) / F.col("w")).alias("m"))
    ci = means.groupBy(*group).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    one = F.col("n") < 2
    return base.join(ci, group, "left").select(*group, "n", "mean", F.when(one, F.col("mean")).otherwise(F.col("low")).alias("low"),
                                               F.when(one, F.col("mean")).otherwise(F.col("high")).alias("high"))

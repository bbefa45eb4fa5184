"""Many multinomial logistic models in the same passes over the rows.

A response is a way to label the rows: as they are, or permuted, each with its own penalty. All responses and all folds are columns of one
design: a pass over the rows adds up the gradients of every model, blocks of them are summed by Spark, and one step is taken for all. What a
pass brings to the driver is a gradient a model, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FOLDS, SEED
from ..functions.skew import ranked, seeded_order
from ..session import materialize
from .folds import CLASSES, Prepared, class_index

#: Responses of one block of gradients, matrix elements that a task works on at once, steps of score at which curves are cut.
BLOCK, AT_ONCE, STEPS = 25, 1 << 22, 1024
#: Share of the tolerance under which a response is left alone.
SETTLED = 1e-3


@dataclass(frozen=True)
class Response:
    """``shuffle``: None for the labels as they are, else the number of a permutation. ``c``: inverse penalty on the summed loss."""

    shuffle: int | None = None
    c: float = 0.5


def shuffler(n: int, seed: int):
    """Function (positions, permutation) -> positions: a different bijection of ``0 .. n-1`` for each permutation.

    Four rounds of a Feistel network on the smallest even number of bits; what falls outside is sent through again until it is inside.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, bits = (1 << half) - 1, np.uint64(half)

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def once(x, r):
        a, b = x >> bits, x & np.uint64(low)
        for k in range(4):
            key = np.uint64((seed * 1_000_003 + r) * 8 + k + 1) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ (mix(b + key) & np.uint64(low))
        return a << bits | b

    def shuffle(pos: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = once(pos.astype(np.uint64), r)
            while (out := x >= np.uint64(n)).any():
                x[out] = once(x[out], r)
        return x.astype(np.int64)
    return shuffle


class Design:
    """Rows with features, class, fold and a position; ``n_slots`` counts rows by (class, fold)."""

    def __init__(self, data: DataFrame, features: list[str], key: str = "author", folds: int = FOLDS, seed: int = SEED):
        """``data`` has ``key, label, fold`` and the features. Gaps are filled and columns scaled over all rows, labels unseen."""
        self.folds, self.classes, self.seed = folds, len(CLASSES), seed
        prep = Prepared(data, features, scale=True)
        placed = ranked(data.withColumn("_h", seeded_order(key, f"p{seed}")), [], "_h", key, "_pos")
        made = prep.apply(placed.withColumn("_y", class_index(F.col("label")).cast("int")), [key, "label", "fold", "_y", "_pos"])
        # Passes are bound by arithmetic, so even few rows are spread over all cores.
        made = made.select(key, "label", "fold", "_y", (F.col("_pos") - 1).alias("_pos"), vector_to_array("features").alias("_x"))
        self.rows = materialize(made.repartition(data.sparkSession.sparkContext.defaultParallelism, key), "design")
        self.key, self.width = key, len(prep.features) + 1
        counts = {(r["_y"], r["fold"]): r["count"] for r in self.rows.groupBy("_y", "fold").count().collect()}
        self.n_slots = np.array([[counts.get((y, k), 0) for k in range(folds)] for y in range(self.classes)], np.int64)

    def _reader(self, responses: list[Response]):
        """Function: Arrow batch -> (features with a constant, slot of each row in each response); a slot is class * folds + fold."""
        n_slots, width, shuffles = self.n_slots, self.width, [r.shuffle for r in responses]
        n, ends, folds = int(n_slots.sum()), np.cumsum(n_slots.ravel()), self.folds
        shuffle = shuffler(n, self.seed)

        def read(batch):
            x = np.ones((batch.num_rows, width))
            x[:, 1:] = np.asarray(batch.column("_x").flatten()).reshape(batch.num_rows, width - 1)
            pos, own = batch.column("_pos").to_numpy(), batch.column("_y").to_numpy() * folds + batch.column("fold").to_numpy()
            slots = np.empty((batch.num_rows, len(shuffles)), np.int64)
            made = {None: own}
            for j, r in enumerate(shuffles):
                if r not in made:
                    made[r] = np.searchsorted(ends, shuffle(pos, r), "right")
                slots[:, j] = made[r]
            return x, slots
        return read

    def _dealt(self, responses: list[Response]) -> DataFrame:
        """Features and slots of all rows, written once: passes would deal them anew each time."""
        read, kind = self._reader(responses), np.dtype(np.uint8 if self.n_slots.size <= 256 else np.int64)

        def run(batches):
            for batch in batches:
                slots = read(batch)[1].astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("_x"), pa.array([s.tobytes() for s in slots], pa.binary())], names=["_x", "_s"])

        return materialize(self.rows.select("_x", "_pos", "_y", "fold").mapInArrow(run, "_x array<double>, _s binary"), "dealt")

    def _dealt_reader(self, live: np.ndarray):
        width, kind = self.width, np.dtype(np.uint8 if self.n_slots.size <= 256 else np.int64)

        def read(batch):
            x = np.ones((batch.num_rows, width))
            x[:, 1:] = np.asarray(batch.column("_x").flatten()).reshape(batch.num_rows, width - 1)
            slots = np.frombuffer(b"".join(batch.column("_s").to_pylist()), kind).reshape(batch.num_rows, -1)
            return x, slots[:, live].astype(np.int64)
        return read

    def _sums(self, responses: list[Response], work, name: str, dealt: DataFrame | None = None, live: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """Arrays that ``work(x, slots) -> (responses, ...)`` gives for parts of the rows, summed by blocks of responses.

        ``dealt``: the rows with the slots of more responses, of which those at ``live`` are meant (``_dealt``).
        """
        block, r_all, step = BLOCK, len(responses), max(1, AT_ONCE // (len(responses) * self.folds * self.classes))
        read = self._reader(responses) if dealt is None else self._dealt_reader(live)
        rows = self.rows.select("_x", "_pos", "_y", "fold") if dealt is None else dealt

        def run(batches):
            total = None
            for batch in batches:
                x, slots = read(batch)
                for a in range(0, len(x), step):
                    part = work(x[a:a + step], slots[a:a + step])
                    total = part if total is None else total + part
            if total is not None:
                at = range(0, r_all, block)
                yield pa.RecordBatch.from_arrays([pa.array([a // block for a in at], pa.int32()), pa.array([total[a:a + block].tobytes() for a in at], pa.binary())], names=["block", "s"])

        def add(table: pa.Table) -> pa.Table:
            s = sum(np.frombuffer(v) for v in table["s"].to_pylist())
            return pa.table({"block": table["block"].slice(0, 1), "s": pa.array([s.tobytes()], pa.binary())})

        made = rows.mapInArrow(run, "block int, s binary").groupBy("block").applyInArrow(add, "block int, s binary")
        return {r["block"]: np.frombuffer(r["s"]) for r in made.collect()}

    def _joined(self, parts: dict[int, np.ndarray], shape: tuple) -> np.ndarray:
        return np.concatenate([parts[b] for b in sorted(parts)]).reshape(shape)

    def class_weights(self) -> np.ndarray:
        """(fold, class): weight of a training row as a share of all; 0 where a class has no training row."""
        train = self.n_slots.sum(1)[None, :] - self.n_slots.T
        present = (train > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            return np.where(train > 0, 1.0 / (present * train), 0.0)

    def fit(self, responses: list[Response], max_iter: int = 300, tol: float = 1e-3) -> np.ndarray:
        """Coefficients (response, fold, feature, class) of balanced logistic regressions that leave a fold out each.

        Steps go along a fixed upper bound of the curvature (half the weighted second moments and the penalty) with momentum that restarts
        when it points uphill, so no step needs a second pass. The last step moved no coefficient by ``tol`` or more; responses that moved by
        less than a thousandth of it are left as they are while others go on.
        """
        r_all, folds, k, d = len(responses), self.folds, self.classes, self.width
        share = self.class_weights()
        of_slot = np.repeat(np.arange(k), folds), np.tile(np.arange(folds), k)
        # (fold model, slot): weight of a row of that slot.
        weight = np.array([[0.0 if f == m else share[m, c] for c, f in zip(*of_slot)] for m in range(folds)])
        train = self.n_slots.sum() - self.n_slots.sum(0)
        penalty = np.array([[1.0 / (r.c * n) for n in train] for r in responses])
        top = weight.max(0)

        def moments(x, slots):
            return np.einsum("ni,nr,nj->rij", x, top[slots], x, optimize=True)

        dealt, live = self._dealt(responses), np.arange(r_all)
        second = self._joined(self._sums(responses, moments, "moments", dealt, live), (r_all, d, d))
        ridge = np.eye(d)[None, None] * penalty[:, :, None, None]
        ridge[:, :, 0, 0] = 1e-9
        inverse = np.linalg.inv(second[:, None] / 2 + ridge)
        penalty = penalty[:, :, None, None] * np.r_[0.0, np.ones(d - 1)][None, None, :, None]

        w = np.zeros((r_all, folds, d, k))
        ahead, last, age = w.copy(), w.copy(), np.zeros((r_all, folds, 1, 1))
        for _ in range(max_iter):
            some = ahead[live]
            at = some.transpose(2, 0, 1, 3).reshape(d, -1).copy()

            def gradients(x, slots, at=at):
                out, each = np.empty((slots.shape[1], folds, d, k)), folds * k
                # A few responses at a time stay in the processor's cache.
                for a in range(0, len(out), BLOCK):
                    mine = slots[:, a:a + BLOCK]
                    z = (x @ at[:, a * each:(a + BLOCK) * each]).reshape(len(x), -1, folds, k)
                    z -= z.max(3, keepdims=True)
                    p = np.exp(z, out=z)
                    p /= p.sum(3, keepdims=True)
                    np.subtract(p, (mine // folds)[:, :, None, None] == np.arange(k), out=p)
                    p *= weight.T[mine][..., None]
                    out[a:a + BLOCK] = (x.T @ p.reshape(len(x), -1)).reshape(d, -1, folds, k).transpose(1, 2, 0, 3)
                return out

            g = self._joined(self._sums([responses[j] for j in live], gradients, "gradients", dealt, live), some.shape) + penalty[live] * some
            new = some - inverse[live] @ g
            step = new - last[live]
            uphill = ((g * step).sum((2, 3), keepdims=True) > 0)
            age[live] = np.where(uphill, 0.0, age[live] + 1)
            ahead[live] = new + age[live] / (age[live] + 3) * step
            w[live] = last[live] = new
            moved = np.abs(step).max((1, 2, 3))
            if moved.max() < tol:
                break
            live = live[moved >= tol * SETTLED]
        return w

    def aucs(self, responses: list[Response], w: np.ndarray) -> DataFrame:
        """``(response, auc)``: macro AUC of out-of-fold scores, taken at steps of 1/1024 of the score (equal steps count half).

        Rows become counts by (response, class, step) inside the task.
        """
        read, folds, k, steps, d, r_all = self._reader(responses), self.folds, self.classes, STEPS, self.width, len(responses)
        flat = w.transpose(2, 0, 1, 3).reshape(d, -1).copy()
        chunk = max(1, AT_ONCE // (r_all * folds * k))

        def run(batches):
            cell, pos, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:
                x, slots = read(batch)
                for a in range(0, len(x), chunk):
                    z = (x[a:a + chunk] @ flat).reshape(-1, r_all, folds, k)
                    s = slots[a:a + chunk]
                    z = np.take_along_axis(z, (s % folds)[:, :, None, None], 2)[:, :, 0]
                    z = np.exp(z - z.max(2, keepdims=True))
                    z /= z.sum(2, keepdims=True)
                    at = np.minimum((z * steps).astype(np.int64), steps - 1)
                    at += (np.arange(r_all)[:, None] * k + np.arange(k)) * steps
                    hit = ((s // folds)[:, :, None] == np.arange(k)).ravel()
                    every = np.concatenate([cell, at.ravel()])
                    cell, inv = np.unique(every, return_inverse=True)
                    pos = np.bincount(inv, np.concatenate([pos, hit])).astype(np.int64)
                    n = np.bincount(inv, np.concatenate([n, np.ones(hit.size, np.int64)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pos), pa.array(n)], names=["cell", "pos", "n"])

        from pyspark.sql import Window
        cells = (self.rows.select("_x", "_pos", "_y", "fold").mapInArrow(run, "cell long, pos long, n long").groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
                 .select("cell", F.floor(F.col("cell") / steps).alias("curve"), F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double").alias("neg")))
        # A curve has at most STEPS cells.
        below = F.coalesce(F.sum("neg").over(Window.partitionBy("curve").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        per = cells.withColumn("below", below).groupBy("curve").agg(
            (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
        return per.groupBy(F.floor(F.col("curve") / k).cast("int").alias("response")).agg(F.avg("auc").alias("auc"))


def permutation_test(data: DataFrame, features: list[str], permutations: int, c: float = 0.5, key: str = "author", seed: int = SEED) -> DataFrame:
    """``observed, null_mean, null_std, p_value, permutations`` of the macro AUC of cross-validated logistic regression.

    ``data`` has its folds. A permutation deals the (label, fold) pairs of the rows to the rows anew, so every fold keeps its share of
    every class; ``p = (1 + #>=observed) / (1 + P)``. All permutations are fitted in the same passes.
    """
    design = Design(data, features, key, seed=seed)
    responses = [Response(c=c), *[Response(i, c) for i in range(permutations)]]
    auc = materialize(design.aucs(responses, design.fit(responses)), "null_aucs")
    observed = auc.where("response = 0").first()["auc"]
    null = auc.where("response > 0 AND auc IS NOT NULL")
    return null.agg(F.lit(observed).alias("observed"), F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_std"),
                    ((1 + F.count(F.when(F.col("auc") >= observed, 1))) / (1 + F.count("auc"))).alias("p_value"), F.count("auc").alias("permutations"))


def penalty_search(data: DataFrame, features: list[str], cs: list[float], key: str = "author", seed: int = SEED) -> DataFrame:
    """``trial, c, auc`` of logistic regressions of every penalty, best first; the earlier one wins a tie."""
    design = Design(data, features, key, seed=seed)
    responses = [Response(c=c) for c in cs]
    auc = design.aucs(responses, design.fit(responses))
    names = data.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(cs)], "response int, c double")
    return names.join(auc, "response").select(F.col("response").alias("trial"), "c", "auc").orderBy(F.desc_nulls_last("auc"), "trial")

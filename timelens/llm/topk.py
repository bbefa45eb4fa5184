"""Exact top-k inner-product search by pivot-table elimination.

Every vector gets its distances to a fixed set of pivots once (the pivot table). For a query q and a candidate x
the triangle inequality gives ``|q - x| >= max over pivots p of | |q - p| - |x - p| |``, and with
``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2`` that lower bound on the distance is an upper bound on the score.

Candidates are dealt by nearest pivot. The distances of a set of candidates to each pivot lie in an interval, so one
bound holds for the whole set: cells (all candidates of a pivot) that cannot reach a query's threshold never meet it, and
inside a block runs of candidates are visited in the order of their bound until the rest is below each query's k-th
score. Scores of a run are one matrix product.

Pivots come from a sample of ``sample_rows`` rows (those with the smallest id digests), picked far from each other; the
origin is always a pivot, which makes Cauchy-Schwarz part of the bound. The same sample gives each query a starting
threshold: its k-th score among the sample can only be too low, so nothing is lost. The sample, the pivots and the
intervals of the cells have a fixed size and are the only data sent to every task. Query blocks meet candidate blocks
in a keyed cogroup, so the work per task is fixed and the block grid grows with the two tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

SCHEMA = "query_id long, vec_id long, score long"


def quantize(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``(vec_id long, v array<long>)`` of the usable rows: id and vector there, all components finite."""
    x = F.col("v").cast("array<double>")
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
            .select("vec_id", F.transform(x, lambda e: F.floor(e * F.lit(scale))).alias("v")))


def matrix(rows, width: int) -> np.ndarray:
    """Rows as a float64 matrix, shorter vectors filled with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def exact_scores(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, by Python integers cut to the range of a long."""
    if not len(a) or np.abs(a).max(initial=0) * np.abs(q).max(initial=0) * max(1, a.shape[1]) < 2 ** 53:
        return (a @ q).astype(np.int64)
    big = [sum(int(x) * int(y) for x, y in zip(r, q)) for r in a]
    return np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for s in big], dtype=np.int64)


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin and up to ``n`` sample rows, each as far as possible from those before it."""
    picked = [np.zeros(sample.shape[1])]
    far = np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample))):
        far = np.minimum(far, ((sample - picked[-1]) ** 2).sum(1))
        if far.max() <= 0:
            break
        picked.append(sample[int(far.argmax())])
    return np.array(picked)


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((m[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0)) if len(m) * pivots.size < 1 << 22 else \
        np.concatenate([distances(part, pivots) for part in np.array_split(m, 2)])


def upper_bounds(q: np.ndarray, qd: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(query, set) bounds on the score. Sets have the least and largest distance to each pivot and the largest squared norm."""
    gap = np.zeros((len(q), len(low)))
    for p in range(qd.shape[1]):
        np.maximum(gap, qd[:, p, None] - high[None, :, p], out=gap)
        np.maximum(gap, low[None, :, p] - qd[:, p, None], out=gap)
    size = (q ** 2).sum(1)[:, None] + norm[None, :]
    return (size - gap ** 2) / 2 + 1e-9 * size + 1e-6


def search_block(qid, q, qd, start, cid, c, cd, k, run=512):
    """Top k of one candidate block for every query of one query block, exact. ``start``: a score that is not too high."""
    near = cd.argmin(1)
    order = np.lexsort((cd[np.arange(len(cd)), near], near))
    cid, c, cd = cid[order], c[order], cd[order]
    cuts = np.arange(0, len(c), run)
    up = upper_bounds(q, qd, np.minimum.reduceat(cd, cuts), np.maximum.reduceat(cd, cuts), np.maximum.reduceat((c ** 2).sum(1), cuts))
    exact = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * max(1, c.shape[1]) < 2 ** 53
    bound = start.copy()
    held = np.full((len(q), k), -np.inf)
    found, waiting = [], 0

    def best(found):
        """The k best of each query; ties to the smaller id."""
        row, ids, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        at = np.lexsort((ids, ~score, row))
        row, ids, score = row[at], ids[at], score[at]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], ids[keep], score[keep]

    for r in np.argsort(-up.max(0), kind="stable"):
        live = np.flatnonzero(up[:, r] >= bound)
        if not len(live):
            # A later run may still be open for another query.
            continue
        part = slice(cuts[r], cuts[r] + run)
        s = (q[live] @ c[part].T).astype(np.int64) if exact else np.array([exact_scores(c[part], x) for x in q[live]])
        hit = (s >= bound[live, None]) & (cid[None, part] != qid[live, None])
        rows, cols = np.nonzero(hit)
        found.append((live[rows], cid[part][cols], s[rows, cols]))
        waiting += len(rows)
        if waiting > 1 << 20:
            # Many equal scores: those that cannot be among the k best any more go.
            found, waiting = [best(found)], 0
        new = np.flatnonzero(hit.any(1))
        more = np.concatenate([held[live[new]], np.where(hit[new], s[new].astype(np.float64), -np.inf)], 1)
        held[live[new]] = np.partition(more, -k, 1)[:, -k:]
        # One step below, so that a score that a double cannot hold is not lost.
        least = held[live[new]].min(1)
        bound[live[new]] = np.maximum(bound[live[new]], least if exact else np.nextafter(least, -np.inf))
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    row, ids, score = best(found)
    return pd.DataFrame({"query_id": qid[row], "vec_id": ids, "score": score})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0, pivots: int = 24, sample_rows: int = 2048, block_rows: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every query by integer inner product.

    A candidate with the query's id is its own row and left out. Rows without an id, and vectors that are null or hold a
    null or non-finite component, take no part. Vectors of different lengths are compared as if filled with zeros. Rows
    that repeat an id count as separate candidates; a repeated query id is searched once, by the smallest of its vectors (element by element).
    Ties go to the smaller id. Empty tables give no rows. Other columns are ignored.
    """
    spark = candidates.sparkSession
    cand = materialize(quantize(candidates, id_col, vec_col, scale), "topk_index")
    asked = quantize(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    shape = cand.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    ask = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    if not shape["n"] or not ask["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(shape["w"], ask["w"])
    rows = cand.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).collect()
    sample_id, sample = np.array([r["vec_id"] for r in rows]), matrix([r["v"] for r in rows], width)
    piv = spread_pivots(sample, pivots)

    def indexed(batches):
        for pdf in batches:
            m = matrix(pdf["v"].tolist(), width)
            d = distances(m, piv)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [r.tobytes() for r in m], "dist": list(d), "norm": (m ** 2).sum(1), "cell": d.argmin(1).astype("int32")})

    index = materialize(cand.mapInPandas(indexed, "vec_id long, vec binary, dist array<double>, norm double, cell int"), "topk_pivots")
    n_piv = len(piv)
    cells = {r["cell"]: r for r in index.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.array(*[F.min(F.col("dist")[i]) for i in range(n_piv)]).alias("low"),
        F.array(*[F.max(F.col("dist")[i]) for i in range(n_piv)]).alias("high")).collect()}
    names = sorted(cells)
    low, high, norm = (np.array([cells[c][x] for c in names], float) for x in ("low", "high", "norm"))
    blocks = [max(1, -(-cells[c]["n"] // block_rows)) for c in names]

    def asked_rows(batches):
        for pdf in batches:
            m = matrix(pdf["v"].tolist(), width)
            d = distances(m, piv)
            least = []
            for i, v in zip(pdf["vec_id"], m):
                s = np.sort(exact_scores(sample[sample_id != i], v))
                least.append(float(np.nextafter(float(s[-k]), -np.inf)) if len(s) >= k else -np.inf)
            open_ = upper_bounds(m, d, low, high, norm) >= np.array(least)[:, None]
            meets = [[(names[j], b) for j in np.flatnonzero(o) for b in range(blocks[j])] for o in open_]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [r.tobytes() for r in m], "dist": list(d), "least": least,
                                "cell": [[c for c, _ in x] for x in meets], "block": [[b for _, b in x] for x in meets]})

    grid_q = -(-ask["n"] // block_rows)
    of_cell = F.create_map(*[F.lit(int(x)) for c, b in zip(names, blocks) for x in (c, b)])
    left = (asked.mapInPandas(asked_rows, "vec_id long, vec binary, dist array<double>, least double, cell array<int>, block array<int>")
            .withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(grid_q)).cast("int"))
            .withColumn("at", F.explode(F.arrays_zip("cell", "block"))).select("vec_id", "vec", "dist", "least", "qb", "at.cell", "at.block"))
    right = (index.drop("norm").withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), of_cell[F.col("cell")]).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(grid_q - 1)))))

    def block(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        load = lambda col, n: np.frombuffer(b"".join(col), np.float64).reshape(n, -1)
        return search_block(a["vec_id"].to_numpy(), load(a["vec"], len(a)), np.stack(a["dist"]), a["least"].to_numpy(),
                            b["vec_id"].to_numpy(), load(b["vec"], len(b)), np.stack(b["dist"]), k)

    keys = ["qb", "cell", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op1_topk_pivot_table", SQL)
def op1(spark, sf):
    """The 20 best partners of every vector whose id is divisible by 20, among all rows."""
    emb = table(spark, sf, "embeddings")
    return top_k(emb.where(F.col("vec_id") % 20 == 0), emb)

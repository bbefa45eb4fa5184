"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. *Document evidence.* A logistic model over style measures of the whole text gives every document a log odds of being
   good. It is fitted on a bounded sample of labelled rows (``sample_rows``, the rows with the smallest id digests).
2. *Sites.* Grouped sums of that evidence over all documents give each host and each path of a host its number of documents
   and of good ones. The hosts' rates are taken as draws from one Beta distribution, the paths' rates inside a host as
   draws from a Beta around their host's posterior; both strengths come from all rows by the method of moments.
3. *Posterior.* A sparse site is thus shrunk to its host, a sparse host to the global rate. A document's log odds are its
   own, moved by ``weight`` times what its path's posterior differs from the global rate in log odds.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import query, table, text_list
from .langid import held_out

SAMPLE_ROWS = 20_000
#: A document is kept unless the model is fairly sure that it is bad.
MIN_GOOD = 0.3
SPACE = set(b" \t\n\r\x0b\x0c")
KIND = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in SPACE else 4 if b in b".,;:'\"-()?"
                 else 5 if b < 128 else 6 for b in range(256)])
FEATURES = ["lower", "upper", "digit", "space", "plain_punct", "symbol", "wide", "lines", "log_words", "word_len", "distinct", "top_word",
            "long_words", "repeated_lines", "repeated_neighbours", "upper_words", "symbol_words", "packed"]


def measures(text: str) -> list[float]:
    """Style measures of a whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(KIND, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=7) / len(raw)
    ws, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(ws))
    count = Counter(ws)
    names = list(count)
    long_ = sum(count[w] for w in names if len(w) > 20) / n
    upper = sum(count[w] for w in names if len(w) > 1 and w.isupper()) / n
    marked = sum(count[w] for w in names if not w[-1].isalnum() and w[-1] not in ".,;:?'\")-") / n
    again = sum(a == b for a, b in zip(ws, ws[1:])) / n
    return [*kinds.tolist(), len(lines) / n, float(np.log1p(n)) / 10, min(len(text) / n, 50.0) / 10, len(count) / n,
            max(count.values(), default=0) / n, long_, 1 - len(set(lines)) / max(1, len(lines)), again, upper, marked,
            min(1.0, len(zlib.compress(raw, 1)) / len(raw))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
    """Standardised ridge logistic regression by Newton steps: (centre, scale, weights with the intercept last)."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality"):
    """The document model, fitted on at most ``sample_rows`` labelled ids that are not held out.

    An id with several labels counts as good if most of them are. Rows without id or label take no part. Without both
    classes the model says the share of good labels for every text, or one half.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_y")))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")

    def run(batches):
        for batch in batches:
            got = [measures(t) for t in text_list(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    # Copies of an id would pass the bound: one row an id is fitted on.
    got = rows.mapInArrow(run, "_id long, _y double, x array<double>").groupBy("_id").agg(F.first("_y").alias("_y"), F.min("x").alias("x")).collect()
    y = np.array([float(r["_y"] >= 0.5) for r in got])
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.r_[np.zeros(len(FEATURES)), np.log(p / (1 - p))]
    return fit_logistic(np.array([r["x"] for r in got]), y)


def log_odds(texts: list[str], model) -> np.ndarray:
    centre, scale, w = model
    x = np.array([measures(t) for t in texts]).reshape(len(texts), len(FEATURES))
    return np.clip(np.c_[(x - centre) / scale, np.ones(len(x))] @ w, -20, 20)


def evidence(docs: DataFrame, model, host_col: str, path_col: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``host``, ``path`` and ``own`` (the text's log odds) of every row."""
    picked = docs.select(*keep, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                         F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            own = log_odds(text_list(batch.column(batch.num_columns - 1)), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.float64())], names=[*batch.schema.names[:-1], "own"])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], T.StructField("own", T.DoubleType())]))


def strength(groups: DataFrame, mean: str) -> float:
    """Strength of the Beta prior around ``mean`` from group rates (``n``, ``good``), by the method of moments.

    The groups' squared deviations, less what chance in ``n`` draws would give, are the variance between groups.
    """
    m, rate = F.col(mean), F.col("good") / F.col("n")
    got = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (rate - m) ** 2).alias("ss"), F.sum(m * (1 - m)).alias("chance"),
                     F.sum(F.col("n") * m * (1 - m)).alias("spread")).first()
    between = (got["ss"] or 0.0) - (got["chance"] or 0.0)
    return 1e6 if between <= 0 else float(min(1e6, max(1.0, (got["spread"] or 0.0) / between - 1)))


def site_posteriors(ev: DataFrame, smallest: float = 1e-4) -> tuple[DataFrame, float]:
    """``(host, path, n, host_rate, path_rate)`` of every site, and the global rate. Copies of rows count each."""
    p = 1 / (1 + F.exp(-F.col("own")))
    paths = ev.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.round(p, 6).cast("decimal(20,6)")).cast("double").alias("good"))
    paths = materialize(paths, "site_sums")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(1 - smallest, max(smallest, total["good"] / total["n"])) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("mean", F.lit(rate))
    s = strength(hosts, "mean")
    hosts = hosts.select("host", ((F.col("good") + s * rate) / (F.col("n") + s)).alias("host_rate"))
    inside = paths.join(hosts, "host")
    s2 = strength(inside, "host_rate")
    return inside.select("host", "path", F.col("n").cast("long").alias("n"), "host_rate",
                         ((F.col("good") + s2 * F.col("host_rate")) / (F.col("n") + s2)).alias("path_rate")), rate


def posterior(ev: DataFrame, sites: DataFrame, rate: float, weight: float, min_good: float) -> DataFrame:
    odds = lambda c: F.log(c / (1 - c))
    held = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), F.col("path_rate")))
    score = 1 / (1 + F.exp(-(F.col("own") + weight * (odds(held) - float(np.log(rate / (1 - rate)))))))
    return ev.join(sites, ["host", "path"]).withColumn("score", score).withColumn("kept", F.col("score") >= min_good)


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
             weight: float = 0.5, min_good: float = MIN_GOOD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, host, path, own_score, host_rate, path_rate, site_docs, score, kept``.

    ``score`` is the posterior probability of being good; rows under ``min_good`` are not ``kept``. A null text is empty
    and stands as such in the model; null hosts and paths form a site of their own. Repeated rows give repeated results,
    an empty table none. Other columns are dropped.
    """
    model = train(docs, labels, sample_rows, id_col, text_col)
    ev = materialize(evidence(docs.withColumn("_id", F.col(id_col)), model, host_col, path_col, ["_id"], text_col), "quality_evidence")
    sites, rate = site_posteriors(ev)
    out = posterior(ev, sites, rate, weight, min_good)
    return out.select(F.col("_id").alias("doc_id"), "host", "path", (1 / (1 + F.exp(-F.col("own")))).alias("own_score"), "host_rate", "path_rate",
                      F.col("n").alias("site_docs"), "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
              weight: float = 0.5, min_good: float = MIN_GOOD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that ``classify`` keeps. Texts are measured twice and never shuffled for it.

    A null text is empty; null hosts and paths form a site of their own; repeated rows stay or go together; an empty table gives no rows.
    """
    model = train(docs, labels, sample_rows, id_col, text_col)
    sites, rate = site_posteriors(evidence(docs, model, host_col, path_col, [], text_col))
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    lift = sites.select(F.col("host").alias(f"{own}host"), F.col("path").alias(f"{own}path"),
                        F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), F.col("path_rate"))).alias(f"{own}rate"))
    host, path = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host_col, path_col))
    joined = docs.join(materialize(lift, "site_rates"), (host == F.col(f"{own}host")) & (path == F.col(f"{own}path"))).drop(f"{own}host", f"{own}path")
    at, base = docs.columns.index(text_col), float(np.log(rate / (1 - rate)))

    def run(batches):
        for batch in batches:
            held = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            own = log_odds(text_list(batch.column(at)), model) + weight * (np.log(held / (1 - held)) - base)
            part = batch.filter(pa.array(1 / (1 + np.exp(-own)) >= min_good))
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


@query("op4_quality_empirical_bayes")
def op4(spark, sf):
    """Quality of every document: its own evidence with its source and language's posteriors."""
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))

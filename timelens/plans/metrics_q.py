"""Classification metrics, ranking metrics, fairness and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BASE_FEATURES, CROSSES, LABELS, MATCH_FEATURES, PROVIDER_FLAGS, SUBGROUPS
from ..functions import scalar as sc
from ..operators import catalog_search, match, metrics, pair_gradients, ranking
from ..session import shared_dir
from ..sources import tables
from . import views as v
from .registry import query
from .views import INTERACTIONS, SCORES


def preds(spark, sf):
    return metrics.argmax_class(v.scores(spark, sf), ["id", "fold"])


PER = """per0 AS (SELECT c.cls AS "class", count(*) FILTER (label = c.cls AND prediction = c.cls)::DOUBLE AS tp, count(*) FILTER (label = c.cls) AS support,
  count(*) FILTER (prediction = c.cls) AS predicted FROM preds, (VALUES ('crisis'), ('recovery'), ('neither')) c(cls) GROUP BY 1),
per1 AS (SELECT "class", CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM per0),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per1)"""
AUC = """rk AS (SELECT *, rank() OVER (PARTITION BY "class" ORDER BY score) + (count(*) OVER (PARTITION BY "class", score) - 1) / 2.0 AS r FROM scores),
auc AS (SELECT "class", count(*) FILTER (label = "class")::DOUBLE AS n_pos, count(*) FILTER (label <> "class")::DOUBLE AS n_neg,
  (sum(r) FILTER (label = "class") - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS auc FROM rk GROUP BY 1)"""


@query("per_class_metrics", "D41", f"WITH {SCORES}, {PER} SELECT \"class\", precision, recall, f1, support FROM per", "precision recall f1")
def q_per(spark, sf):
    return metrics.per_class(preds(spark, sf))


@query("average_metrics", "D42", f"""WITH {SCORES}, {PER} SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM per""",
       [f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")])
def q_avg(spark, sf):
    return metrics.averages(metrics.per_class(preds(spark, sf)))


@query("class_auc", "D43 E4", f"WITH {SCORES}, {AUC} SELECT \"class\", auc, n_pos, n_neg FROM auc", "auc n_pos n_neg")
def q_auc(spark, sf):
    return metrics.class_auc(v.scores(spark, sf))


@query("macro_auc", "D43", f"WITH {SCORES}, {AUC} SELECT avg(auc) AS auc FROM auc", "auc")
def q_mauc(spark, sf):
    return metrics.macro_auc(metrics.class_auc(v.scores(spark, sf)))


ROC = """rc AS (SELECT "class", score, count(*) FILTER (label = "class")::DOUBLE AS pos, count(*) FILTER (label <> "class")::DOUBLE AS neg FROM scores GROUP BY 1, 2),
roc AS (SELECT "class", score, sum(neg) OVER (PARTITION BY "class" ORDER BY score DESC) / sum(neg) OVER (PARTITION BY "class") AS fpr,
  sum(pos) OVER (PARTITION BY "class" ORDER BY score DESC) / sum(pos) OVER (PARTITION BY "class") AS tpr FROM rc)"""


@query("roc_points", "D44 E7", f"WITH {SCORES}, {ROC} SELECT * FROM roc", "score fpr tpr")
def q_roc(spark, sf):
    return metrics.roc_points(v.scores(spark, sf))


@query("macro_roc_curve", "D44", f"""WITH {SCORES}, {ROC},
runs AS (SELECT "class", fpr, min(tpr) AS lo, max(tpr) AS hi FROM (SELECT "class", fpr, tpr FROM roc UNION ALL SELECT DISTINCT "class", 0.0, 0.0 FROM roc) GROUP BY 1, 2),
seg AS (SELECT *, lead(fpr) OVER w AS x1, lead(lo) OVER w AS y1 FROM runs WINDOW w AS (PARTITION BY "class" ORDER BY fpr)),
g AS (SELECT range AS point, range / 199.0::DOUBLE AS x FROM range(200)),
i AS (SELECT g.point, g.x, s."class", CASE WHEN x1 IS NULL OR x <= fpr + 1e-12 THEN hi ELSE hi + (y1 - hi) * (x - fpr) / (x1 - fpr) END AS tpr
  FROM g ASOF JOIN seg s ON s."class" IS NOT NULL AND g.x + 1e-12 >= s.fpr AND s."class" = 'crisis'
  UNION ALL SELECT g.point, g.x, s."class", CASE WHEN x1 IS NULL OR x <= fpr + 1e-12 THEN hi ELSE hi + (y1 - hi) * (x - fpr) / (x1 - fpr) END
  FROM g ASOF JOIN (SELECT * FROM seg WHERE "class" = 'recovery') s ON g.x + 1e-12 >= s.fpr
  UNION ALL SELECT g.point, g.x, s."class", CASE WHEN x1 IS NULL OR x <= fpr + 1e-12 THEN hi ELSE hi + (y1 - hi) * (x - fpr) / (x1 - fpr) END
  FROM g ASOF JOIN (SELECT * FROM seg WHERE "class" = 'neither') s ON g.x + 1e-12 >= s.fpr)
SELECT CAST(point AS INTEGER) AS point, x AS fpr, avg(tpr) AS tpr FROM i GROUP BY 1, 2""".replace(
    """FROM g ASOF JOIN seg s ON s."class" IS NOT NULL AND g.x + 1e-12 >= s.fpr AND s."class" = 'crisis'""",
    """FROM g ASOF JOIN (SELECT * FROM seg WHERE "class" = 'crisis') s ON g.x + 1e-12 >= s.fpr"""), "fpr tpr")
def q_macro_roc(spark, sf):
    return metrics.macro_roc(metrics.roc_points(v.scores(spark, sf)))


# ------------------------------------------------------------------ metric tables
def metric_rows(spark, sf, dataset, model):
    """Long metrics of the score table; ``high_conf`` leaves out low scores of recovery rows."""
    sco = v.scores(spark, sf)
    if dataset == "high_conf":
        sco = sco.filter(~((F.col("label") == "recovery") & (F.col("id") % 4 == 0)))
    if model == "flipped":
        sco = sco.withColumn("score", 1.0 - F.col("score"))
    ids = {"experiment": "raw", "dataset": dataset, "model": model}
    return metrics.evaluate(metrics.argmax_class(sco, ["id"]), sco, ids)


def metric_sql(dataset, model):
    """Same rows in SQL for one dataset and model."""
    keep = "NOT (label = 'recovery' AND id % 4 = 0)" if dataset == "high_conf" else "true"
    score = "1.0 - score" if model == "flipped" else "score"
    base = f"""scores AS (SELECT id, label, fold, "class", {score} AS score FROM raw_scores WHERE {keep}),
    preds AS (SELECT id, label, fold, arg_min("class", (-score, "class")) AS prediction FROM scores GROUP BY ALL)"""
    return f"""(WITH {base}, {PER}, {AUC},
    both_t AS (SELECT p."class", precision, recall, f1, support::DOUBLE AS support, auc AS roc_auc FROM per p JOIN auc a USING ("class"))
    SELECT 'raw' AS experiment, '{dataset}' AS dataset, '{model}' AS model, 'class' AS scope, "class", metric, value FROM both_t UNPIVOT INCLUDE NULLS (value FOR metric IN (precision, recall, f1, support, roc_auc))
    UNION ALL SELECT 'raw', '{dataset}', '{model}', 'macro', NULL, metric, value FROM (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(roc_auc) AS roc_auc FROM both_t) UNPIVOT (value FOR metric IN (precision, recall, f1, roc_auc))
    UNION ALL SELECT 'raw', '{dataset}', '{model}', 'weighted', NULL, metric, value FROM (SELECT sum(precision*support)/sum(support) AS precision, sum(recall*support)/sum(support) AS recall, sum(f1*support)/sum(support) AS f1 FROM both_t) UNPIVOT (value FOR metric IN (precision, recall, f1)))"""


RAW = SCORES.replace("scores AS (", "raw_scores AS (", 1).split(",\npreds AS")[0]
COMBOS = [("full", "straight"), ("full", "flipped"), ("high_conf", "straight")]
MT = f"{RAW}, mt AS ({' UNION ALL '.join(metric_sql(d, m) for d, m in COMBOS)})"


def metric_table(spark, sf):
    out = None
    for d, m in COMBOS:
        rows = metric_rows(spark, sf, d, m)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("metrics_json_sink", "A5 D41 D42 D43", f"WITH {MT} SELECT * FROM mt", "value")
def q_sink(spark, sf):
    path = shared_dir(spark, "metrics")
    tables.write_metrics(metric_table(spark, sf), path)
    return tables.read_metrics(spark, path)


@query("sensitivity_table", "D45", f"""WITH {MT} SELECT a.experiment, a.model, a."class", a.metric, a.value - b.value AS delta
FROM mt a JOIN mt b ON a.model = b.model AND a."class" = b."class" AND a.metric = b.metric
WHERE a.dataset = 'high_conf' AND b.dataset = 'full' AND a.metric IN ('f1', 'roc_auc') AND a.scope = 'class' AND b.scope = 'class'""", "delta")
def q_sens(spark, sf):
    return metrics.sensitivity(metric_table(spark, sf))


@query("leaderboard", "D46 E5", f"""WITH {MT}, l AS (SELECT experiment, dataset, model, max(value) FILTER (metric = 'roc_auc') AS auc, max(value) FILTER (metric = 'f1') AS f1
  FROM mt WHERE scope = 'macro' GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY auc DESC NULLS LAST, experiment, dataset, model) AS place FROM l""", "auc f1")
def q_lead(spark, sf):
    return metrics.leaderboard(metric_table(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("compare_runs", "C12", f"""WITH {MT} SELECT a.experiment, a.dataset, a.model, a.value AS old_auc, 1.0 - a.value AS new_auc, 1.0 - 2 * a.value AS delta
FROM mt a WHERE scope = 'macro' AND metric = 'roc_auc'""", "old_auc new_auc delta")
def q_compare(spark, sf):
    old = metric_table(spark, sf)
    new = old.withColumn("value", F.when(F.col("metric") == "roc_auc", 1.0 - F.col("value")).otherwise(F.col("value")))
    return metrics.compare_runs(old, new)


FOLD = """fm AS (SELECT id, label, fold, "class", score, 'straight' AS model FROM scores UNION ALL SELECT id, label, fold, "class", 1.0 - score, 'flipped' FROM scores),
fr AS (SELECT *, rank() OVER (PARTITION BY model, fold, "class" ORDER BY score) + (count(*) OVER (PARTITION BY model, fold, "class", score) - 1) / 2.0 AS r FROM fm),
fa AS (SELECT model, fold, "class", count(*) FILTER (label = "class")::DOUBLE AS n_pos, count(*) FILTER (label <> "class")::DOUBLE AS n_neg,
  (sum(r) FILTER (label = "class") - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS auc FROM fr GROUP BY 1, 2, 3),
ff AS (SELECT model, fold, avg(auc) AS auc FROM fa GROUP BY 1, 2)"""


def fold_scores(spark, sf):
    s = v.scores(spark, sf)
    return s.withColumn("model", F.lit("straight")).unionByName(s.withColumn("score", 1.0 - F.col("score")).withColumn("model", F.lit("flipped")))


@query("fold_auc_summary", "D47", f"WITH {SCORES}, {FOLD} SELECT model, avg(auc) AS mean_auc, stddev_samp(auc) AS std_auc, count(auc) AS folds FROM ff GROUP BY model", "mean_auc std_auc")
def q_fold(spark, sf):
    return metrics.fold_auc_summary(fold_scores(spark, sf), ["model"])


@query("best_model_per_config", "D47", f"""WITH {SCORES}, {FOLD}, s AS (SELECT 'all' AS config, model, avg(auc) AS mean_auc FROM ff GROUP BY model)
SELECT config, arg_max(model, mean_auc) AS best, max(mean_auc) AS mean_auc FROM s GROUP BY config""", "mean_auc")
def q_best(spark, sf):
    s = metrics.fold_auc_summary(fold_scores(spark, sf), ["model"]).withColumn("config", F.lit("all"))
    return metrics.best_model(s, "config")


@query("seed_summary", "M14", f"WITH {SCORES}, {FOLD} SELECT model, avg(auc) AS mean, stddev_samp(auc) AS std, min(auc) AS min, max(auc) AS max, count(auc) AS n FROM ff GROUP BY model", "mean std min max")
def q_seed(spark, sf):
    """Folds stand for seeds: one AUC per model and seed, summarised."""
    per = metrics.macro_auc(metrics.class_auc(fold_scores(spark, sf), ["model", "fold"]), ["model", "fold"])
    return metrics.seed_summary(per, ["model"])


@query("probability_blend", "M8", f"WITH {SCORES}, {FOLD.split(',' + chr(10) + 'fr')[0]} SELECT id, \"class\", avg(score) AS proba FROM fm GROUP BY 1, 2", "proba")
def q_blend(spark, sf):
    return metrics.blend(fold_scores(spark, sf).withColumnRenamed("score", "proba"), ["id"])


@query("class_weights", "M2", f"WITH {SCORES} SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight FROM preds GROUP BY label", "weight")
def q_weights(spark, sf):
    return metrics.class_weights(v.scores(spark, sf).select("id", "label").distinct())


# ------------------------------------------------------------------ ranking and regression
@query("engagement_label", "H19", f"WITH {INTERACTIONS} SELECT id, type, rating, y FROM ix", "y")
def q_label(spark, sf):
    return v.interactions(spark, sf).select("id", "type", "rating", "y")


@query("regression_errors", "D48", f"WITH {INTERACTIONS} SELECT sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae FROM ix", "rmse mae")
def q_err(spark, sf):
    return ranking.errors(v.interactions(spark, sf))


@query("spearman", "D49 E4", f"""WITH {INTERACTIONS},
r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM ix)
SELECT corr(a, b) AS spearman FROM r""", "spearman")
def q_spear(spark, sf):
    return ranking.spearman(v.interactions(spark, sf).select("y", "p"))


NDCG = """d AS (SELECT grp, y, row_number() OVER (PARTITION BY grp ORDER BY p DESC, id) AS a, row_number() OVER (PARTITION BY grp ORDER BY y DESC, id) AS b, count(*) OVER (PARTITION BY grp) AS n FROM src),
e AS (SELECT grp, n, sum((2^y - 1) / log2(a + 1)) FILTER (a <= 5) AS dcg, sum((2^y - 1) / log2(b + 1)) FILTER (b <= 5) AS idcg FROM d GROUP BY grp, n)
SELECT avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 1.0 END) AS ndcg FROM e"""


@query("ndcg_overall", "D50 E6", f"WITH {INTERACTIONS}, src AS (SELECT 0 AS grp, id, y, p FROM ix), {NDCG}", "ndcg")
def q_ndcg(spark, sf):
    return ranking.ndcg(v.interactions(spark, sf).select("id", "y", "p"))


@query("ndcg_by_group", "D50 E6", f"WITH {INTERACTIONS}, src AS (SELECT grp, id, y, p FROM ix), {NDCG} WHERE n >= 2", "ndcg")
def q_gndcg(spark, sf):
    return ranking.ndcg(v.interactions(spark, sf).select("id", "y", "p", "group"), group="group")


FAIR_COL = {"insurance": "insurance", "age_group": "age_group", "urgency": "urgency"}
FAIR = ", ".join(f"('{g}', '{n}', {v._LIST(vals)})" for g, subs in SUBGROUPS.items() for n, vals in subs.items())
FAIR_SQL = f"""sub AS (SELECT * FROM (VALUES {FAIR}) s("group", subgroup, vals)),
f0 AS (SELECT s."group", s.subgroup, count(ix.id) AS n, sqrt(avg((y-p)*(y-p))) AS r, avg(abs(y-p)) AS a, avg(p) AS mp, avg(y) AS mt
  FROM sub s LEFT JOIN ix ON list_contains(s.vals, CASE s."group" WHEN 'insurance' THEN ix.insurance WHEN 'age_group' THEN ix.age_group ELSE ix.urgency END) GROUP BY 1, 2),
fair AS (SELECT "group", subgroup, n, CASE WHEN n >= 2 THEN round(r, 5) END AS rmse, CASE WHEN n >= 2 THEN round(a, 5) END AS mae, CASE WHEN n >= 2 THEN round(mp, 4) END AS mean_pred,
  CASE WHEN n >= 2 THEN round(mt, 4) END AS mean_true, CASE WHEN n >= 2 THEN round(mp - mt, 4) END AS gap FROM f0)"""


@query("fairness_audit", "D51 U3", f"WITH {INTERACTIONS}, {FAIR_SQL} SELECT * FROM fair", "rmse mae mean_pred mean_true gap")
def q_fair(spark, sf):
    return ranking.fairness(v.interactions(spark, sf), ranking.subgroup_rules())


@query("max_disparity", "D52", f"""WITH {INTERACTIONS}, {FAIR_SQL}, m AS (SELECT "group", CASE WHEN count(mean_pred) >= 2 THEN round(max(mean_pred) - min(mean_pred), 4) ELSE 0.0 END AS max_disparity FROM fair GROUP BY 1)
SELECT *, max_disparity > 0.15 AS flagged FROM m""", "max_disparity")
def q_disp(spark, sf):
    return ranking.disparity(ranking.fairness(v.interactions(spark, sf), ranking.subgroup_rules()))


@query("interaction_profile", "D53", f"""WITH {INTERACTIONS} SELECT coalesce(type, 'all') AS type, count(*) AS n, min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean,
  min(rating) AS rating_min, max(rating) AS rating_max, avg(rating) AS rating_mean, 100.0 * count(*) / (SELECT count(*) FROM ix) AS percent FROM ix GROUP BY ROLLUP (type)""",
       "score_mean rating_mean percent")
def q_profile(spark, sf):
    return ranking.profile(v.interactions(spark, sf), "type", "score", "rating")


@query("top_providers", "D53 F2", f"WITH {INTERACTIONS} SELECT provider_id, count(*) AS n FROM ix GROUP BY 1 ORDER BY n DESC, provider_id LIMIT 10")
def q_topprov(spark, sf):
    from ..operators.reports import counts_by
    return counts_by(v.interactions(spark, sf), "provider_id", 10)


@query("interactions_by_time", "F4", f"WITH {INTERACTIONS} SELECT id, ts, type, row_number() OVER (ORDER BY ts, id) AS place FROM ix")
def q_sorted(spark, sf):
    """Time order with its position, ranked slice by slice rather than in one task."""
    from ..functions.skew import ranked
    ix = v.interactions(spark, sf).select("id", "ts", "type").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return ranked(ix, [], "us", "id", "place").drop("us").withColumn("place", F.col("place").cast("long")).orderBy("ts", "id")


@query("dataset_fingerprint", "D54", f"""WITH {INTERACTIONS} SELECT count(*) AS n,
  CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), type, coalesce(CAST(rating AS VARCHAR), '~'))), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM ix""")
def q_fp(spark, sf):
    return ranking.fingerprint(v.interactions(spark, sf), ["id", "type", "rating"])


@query("ordered_fingerprint", "D54", """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, CAST(o_orderkey AS VARCHAR) AS t FROM orders),
l1 AS (SELECT n // 1000 AS n, md5(string_agg(t, ', ' ORDER BY n)) AS t FROM r GROUP BY 1),
l2 AS (SELECT n // 1000 AS n, md5(string_agg(t, ', ' ORDER BY n)) AS t FROM l1 GROUP BY 1),
l3 AS (SELECT n // 1000 AS n, md5(string_agg(t, ', ' ORDER BY n)) AS t FROM l2 GROUP BY 1)
SELECT substr(t, 1, 8) AS fingerprint FROM l3""")
def q_ofp(spark, sf):
    return ranking.ordered_fingerprint(v.table(spark, sf, "orders"), "o_orderkey", "o_orderkey")


@query("ordered_list_hash", "D54", f"""WITH {INTERACTIONS} SELECT substr(md5('[' || string_agg(CAST(y AS VARCHAR), ', ' ORDER BY id) || ']'), 1, 8) AS data_hash FROM ix""")
def q_lhash(spark, sf):
    """The labels in id order as one JSON list, digested as defined."""
    return ranking.list_hash(v.interactions(spark, sf), "id", "y")


@query("pairwise_weights", "M19 C7 H21", f"""WITH {INTERACTIONS},
c AS (SELECT y, p, count(*)::DOUBLE AS n FROM ix GROUP BY 1, 2),
l AS (SELECT a.y, a.p, sum(CASE WHEN a.y > b.y THEN -b.n * (1 / (1 + exp(a.p - b.p))) * (a.y - b.y) WHEN a.y < b.y THEN b.n * (1 / (1 + exp(b.p - a.p))) * (b.y - a.y) ELSE 0 END) AS lam
  FROM c a, c b GROUP BY 1, 2),
w AS (SELECT id, abs(lam) + 1 AS raw FROM ix JOIN l USING (y, p))
SELECT id, raw / (SELECT avg(raw) FROM w) AS weight FROM w""", "weight")
def q_pair(spark, sf):
    return ranking.pair_weights(v.interactions(spark, sf).select("id", "y", "p"))


@query("pairwise_weights_by_group", "M19 C7", f"""WITH {INTERACTIONS},
l AS (SELECT a.id, sum(CASE WHEN a.y > b.y THEN -(1 / (1 + exp(a.p - b.p))) * (a.y - b.y) WHEN a.y < b.y THEN (1 / (1 + exp(b.p - a.p))) * (b.y - a.y) ELSE 0 END) AS lam
  FROM ix a JOIN ix b ON a.grp = b.grp GROUP BY 1), w AS (SELECT id, abs(lam) + 1 AS raw FROM l)
SELECT id, raw / (SELECT avg(raw) FROM w) AS weight FROM w""", "weight")
def q_gpair(spark, sf):
    return ranking.pair_weights(v.interactions(spark, sf).select("id", "y", "p", "group"), group="group")


@query("pairwise_weights_continuous", "M19 C7", """WITH ix AS (SELECT c_custkey AS id, c_acctbal / 1000 AS y, (c_custkey * 7919 % 100003) / 1000.0::DOUBLE AS p, c_mktsegment AS grp FROM customer),
l AS (SELECT a.id, sum(CASE WHEN a.y > b.y THEN -(1 / (1 + exp(a.p - b.p))) * (a.y - b.y) WHEN a.y < b.y THEN (1 / (1 + exp(b.p - a.p))) * (b.y - a.y) ELSE 0 END) AS lam
  FROM ix a JOIN ix b ON a.grp = b.grp GROUP BY 1), w AS (SELECT id, abs(lam) + 1 AS raw FROM l)
SELECT id, raw / (SELECT avg(raw) FROM w) AS weight FROM w""", "weight")
def q_cpair(spark, sf):
    """Nearly as many labels as rows, predictions over a hundred cells."""
    c = v.table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("y"), (F.col("c_custkey") * 7919 % 100003 / 1000.0).alias("p"), F.col("c_mktsegment").alias("group"))
    return pair_gradients.pair_weights(rows, group="group")


# ------------------------------------------------------------------ matching
FLAG = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
BASE_SQL = {
    "insurance_match": FLAG("id % 2 = 0"), "insurance_partial": FLAG("id % 3 = 0"), "age_match": FLAG("id % 5 = 0"),
    "concerns_overlap": "(id % 5) / 4.0", "telehealth_match": FLAG("id % 7 = 0"), "crisis_match": FLAG("urgency = 'crisis' AND has_crisis"),
    "language_match": FLAG("id % 11 = 0"), "gender_match": FLAG("id % 13 = 0"), "modality_overlap": "(id % 4) / 3.0",
    "cultural_overlap": "(id % 3) / 2.0", "has_crisis_services": FLAG("has_crisis"), "urgency_is_crisis": FLAG("urgency = 'crisis'"),
    "urgency_is_urgent": FLAG("urgency = 'urgent'"), "user_uninsured": FLAG("insurance IN ('uninsured', 'sliding_scale')"),
}
FEATS = f"""fx0 AS (SELECT ix.id, y, p, {', '.join(f'{BASE_SQL.get(n, FLAG(n))} AS f_{n}' for n in BASE_FEATURES)} FROM ix LEFT JOIN prov USING (provider_id)),
fx AS (SELECT id, y, p, {', '.join(f'f_{n} AS {n}' for n in BASE_FEATURES)}, {', '.join(f'f_{a} * f_{b} AS {n}' for a, b, n in CROSSES)} FROM fx0)"""


def features(spark, sf):
    ix = v.interactions(spark, sf)
    return match.match_features(match.with_provider(ix, v.providers(spark, sf)))


@query("provider_flags_join", "C5", f"WITH {INTERACTIONS} SELECT ix.id, ix.provider_id, {', '.join(f'coalesce({c}, false) AS {c}' for c in PROVIDER_FLAGS)} FROM ix LEFT JOIN (SELECT * FROM prov WHERE provider_id % 7 <> 0) USING (provider_id)")
def q_prov(spark, sf):
    """Some providers are missing from the catalog."""
    known = v.providers(spark, sf).filter("provider_id % 7 <> 0")
    return match.with_provider(v.interactions(spark, sf).select("id", "provider_id"), known)


@query("match_feature_vector", "M28 H20 H22", f"WITH {INTERACTIONS}, {FEATS} SELECT id, {', '.join(MATCH_FEATURES)} FROM fx", MATCH_FEATURES)
def q_feats(spark, sf):
    return features(spark, sf).select("id", *MATCH_FEATURES)


@query("scaler_statistics", "D56", f"""WITH {INTERACTIONS}, {FEATS} SELECT f.feature, avg(x) AS mean, stddev_pop(x) AS std, count(x) AS n FROM (SELECT f.feature, CASE f.feature {' '.join(f"WHEN '{c}' THEN {c}" for c in MATCH_FEATURES)} END AS x
  FROM fx, (VALUES {', '.join(f"('{c}')" for c in MATCH_FEATURES)}) f(feature)) f GROUP BY 1""", "mean std")
def q_scaler(spark, sf):
    return metrics.column_stats(features(spark, sf), MATCH_FEATURES)


WEIGHTS = {c: round(((i * 7) % 11 - 5) / 50.0, 5) for i, c in enumerate(MATCH_FEATURES)}


@query("linear_attributions", "M22 E5", f"""WITH {INTERACTIONS}, {FEATS},
s AS (SELECT f.feature, f.weight, avg(abs(f.weight * x)) AS mean_abs FROM (SELECT f.feature, f.weight, CASE f.feature {' '.join(f"WHEN '{c}' THEN ({c} - 0.5) / 0.25" for c in MATCH_FEATURES)} END AS x
  FROM fx, (VALUES {', '.join(f"('{c}', {w!r}::DOUBLE)" for c, w in WEIGHTS.items())}) f(feature, weight)) f GROUP BY 1, 2)
SELECT feature, round(weight, 5) AS weight, CAST(row_number() OVER (ORDER BY abs(weight) DESC, feature) AS INTEGER) AS place,
  CASE WHEN weight > 0 THEN 'positive' WHEN weight < 0 THEN 'negative' ELSE 'neutral' END AS direction, round(abs(weight), 5) AS abs_importance, mean_abs FROM s""", "weight abs_importance mean_abs")
def q_attr(spark, sf):
    stats = {c: (0.5, 0.25) for c in MATCH_FEATURES}
    return ranking.attribution_summary(ranking.attributions(features(spark, sf), WEIGHTS, stats), WEIGHTS)


# catalog of full providers: suppliers with rule-made listings
CATALOG_SQL = """cat AS (SELECT s_suppkey AS provider_id,
  list_filter(['medicaid','medicare','bcbs','cigna','aetna','uhc','uninsured','sliding_scale'], lambda x, i: (s_suppkey + i) % 3 = 0) AS p_ins,
  list_filter(['child','teen','adult','senior'], lambda x, i: (s_suppkey + i) % 2 = 0) AS p_ages,
  list_filter(['depression','anxiety','trauma','ocd','grief'], lambda x, i: (s_suppkey + i) % 2 = 1) AS p_con,
  list_filter(['cbt','dbt','emdr','mi'], lambda x, i: (s_suppkey + i) % 3 <> 0) AS p_mod,
  list_filter(['lgbtq_affirming','feminist'], lambda x, i: (s_suppkey + i) % 2 = 0) AS p_cul,
  CASE WHEN s_suppkey % 4 = 0 THEN ['english','spanish'] WHEN s_suppkey % 4 = 1 THEN ['english'] END AS p_lang,
  s_nationkey % 2 = 0 AS p_tele, s_nationkey % 3 = 0 AS p_crisis FROM supplier),
req AS (SELECT event_id AS id, (['medicaid','medicare','bcbs','cigna','aetna','uhc','uninsured','any'])[event_id % 8 + 1] AS ins, (['child','teen','adult','any'])[event_id % 4 + 1] AS age,
  (['required','preferred','in_person','any'])[(event_id // 4) % 4 + 1] AS tele, (['crisis','urgent','routine','exploring'])[(event_id // 8) % 4 + 1] AS urg,
  (['english','spanish','any'])[event_id % 3 + 1] AS lang, (['woman','any'])[event_id % 2 + 1] AS gen,
  list_filter(['depression','anxiety','trauma','ocd','grief'], lambda x, i: (event_id + i) % 4 = 0) AS con,
  list_filter(['cbt','dbt','emdr','mi'], lambda x, i: (event_id + i) % 5 = 0) AS md,
  list_filter(['lgbtq_affirming','feminist'], lambda x, i: (event_id + i) % 3 = 0) AS cul FROM events)"""
OV = "(len(list_intersect({0}, {1}))::DOUBLE / len({0}))"
TELE = "(tele IN ('any', 'in_person') OR (tele IN ('required', 'preferred') AND p_tele))"
LANG = "(lang = 'any' OR list_contains(coalesce(p_lang, ['english']), lang))"
RULE_SQL = f"""least(100, CASE WHEN ins = 'any' OR list_contains(p_ins, ins) THEN 26 WHEN list_contains(p_ins, 'sliding_scale') OR list_contains(p_ins, 'uninsured') THEN 8 ELSE 0 END
 + CASE WHEN age = 'any' OR list_contains(p_ages, age) THEN 18 ELSE 0 END
 + CASE WHEN len(con) = 0 THEN 8 ELSE CAST(floor(17 * {OV.format('con', 'p_con')}) AS INTEGER) END
 + CASE WHEN {TELE} THEN 11 WHEN tele = 'preferred' THEN 4 ELSE 0 END
 + CASE WHEN urg IN ('routine', 'exploring') THEN 9 WHEN urg = 'crisis' AND p_crisis THEN 9 WHEN urg = 'urgent' AND p_crisis THEN 7 ELSE 0 END
 + CASE WHEN {LANG} THEN 4 ELSE 0 END + CASE WHEN gen = 'any' THEN 3 ELSE 0 END
 + CASE WHEN len(md) = 0 THEN 2 ELSE CAST(floor(4 * {OV.format('md', 'p_mod')}) AS INTEGER) END
 + CASE WHEN len(cul) = 0 THEN 1 ELSE CAST(floor(2 * {OV.format('cul', 'p_cul')}) AS INTEGER) END + 6)"""


def pick(values, key):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (key + 1).cast("int"))


def some(values, key, mod, keep):
    """Items whose one-based position passes a rule on ``key + position``."""
    arr = F.array(*[F.lit(x) for x in values])
    return F.filter(arr, lambda x, i: keep((key + i + 1) % mod))


def catalog(spark, sf):
    s = F.col("s_suppkey")
    return v.table(spark, sf, "supplier").select(
        s.alias("provider_id"),
        some(["medicaid", "medicare", "bcbs", "cigna", "aetna", "uhc", "uninsured", "sliding_scale"], s, 3, lambda m: m == 0).alias("insurance"),
        some(["child", "teen", "adult", "senior"], s, 2, lambda m: m == 0).alias("ages"),
        some(["depression", "anxiety", "trauma", "ocd", "grief"], s, 2, lambda m: m == 1).alias("concerns"),
        some(["cbt", "dbt", "emdr", "mi"], s, 3, lambda m: m != 0).alias("modalities"),
        some(["lgbtq_affirming", "feminist"], s, 2, lambda m: m == 0).alias("cultural"),
        F.when(s % 4 == 0, F.array(F.lit("english"), F.lit("spanish"))).when(s % 4 == 1, F.array(F.lit("english"))).alias("languages"),
        (F.col("s_nationkey") % 2 == 0).alias("telehealth"), (F.col("s_nationkey") % 3 == 0).alias("crisis"))


def requests(spark, sf):
    e = F.col("event_id")
    return v.widen(v.table(spark, sf, "events").select("event_id"), "event_id").select(
        e.alias("id"),
        pick(["medicaid", "medicare", "bcbs", "cigna", "aetna", "uhc", "uninsured", "any"], e % 8).alias("insurance"),
        pick(["child", "teen", "adult", "any"], e % 4).alias("ageGroup"), pick(["required", "preferred", "in_person", "any"], F.floor(e / 4) % 4).alias("telehealth"),
        pick(["crisis", "urgent", "routine", "exploring"], F.floor(e / 8) % 4).alias("urgency"),
        pick(["english", "spanish", "any"], e % 3).alias("language"), pick(["woman", "any"], e % 2).alias("providerGender"),
        some(["depression", "anxiety", "trauma", "ocd", "grief"], e, 4, lambda m: m == 0).alias("concerns"),
        some(["cbt", "dbt", "emdr", "mi"], e, 5, lambda m: m == 0).alias("modalities"),
        some(["lgbtq_affirming", "feminist"], e, 3, lambda m: m == 0).alias("cultural"))


REQ = ["insurance", "ageGroup", "telehealth", "urgency", "language", "providerGender", "concerns", "modalities", "cultural"]
PRV = ["insurance", "ages", "concerns", "modalities", "cultural", "languages", "telehealth", "crisis"]


def paired(spark, sf):
    """Distinct requests beside the catalog, and the profile of every request."""
    kinds, of = match.profiles(requests(spark, sf), REQ)
    f = {c: F.col(c) for c in REQ}
    p = {c: F.col("p")[c] for c in PRV}
    return match.beside_providers(kinds, catalog(spark, sf)), f, p, of


@query("rule_score_by_request", "M26 C6 H17 H18", f"""WITH {CATALOG_SQL}, s AS (SELECT id, provider_id, {RULE_SQL} AS sc FROM req, cat)
SELECT id, count(*) AS providers, min(sc) AS worst, max(sc) AS best, CAST(sum(sc) AS BIGINT) AS total, min(provider_id) FILTER (sc = mx) AS best_provider
FROM (SELECT *, max(sc) OVER (PARTITION BY id) AS mx FROM s) GROUP BY id""")
def q_rule(spark, sf):
    pairs, f, p, of = paired(spark, sf)
    s = pairs.select("profile", F.col("p.provider_id").alias("provider_id"), match.rule_score(f, p).alias("sc"))
    top = F.min(F.struct(F.negative("sc").alias("s"), F.col("provider_id")))
    scored = s.groupBy("profile").agg(F.count(F.lit(1)).alias("providers"), F.min("sc").alias("worst"), F.max("sc").alias("best"),
                                      F.sum("sc").alias("total"), top["provider_id"].alias("best_provider"))
    return of.join(scored, "profile").drop("profile")


@query("top_providers_by_request", "M26 C6 F2", f"""WITH {CATALOG_SQL}, s AS (SELECT id, provider_id, {RULE_SQL} AS score FROM req, cat)
SELECT id, rank, provider_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, provider_id) AS rank FROM s) WHERE rank <= 5""")
def q_best_providers(spark, sf):
    """Five best providers of every request by search in the catalog's block tree."""
    return catalog_search.top_providers(requests(spark, sf), catalog(spark, sf))


PF = {"insuranceMatch": "(ins = 'any' OR list_contains(p_ins, ins))",
      "insurancePartial": "(NOT list_contains(p_ins, ins) AND (list_contains(p_ins, 'sliding_scale') OR list_contains(p_ins, 'uninsured')))",
      "ageMatch": "(age = 'any' OR list_contains(p_ages, age))", "telehealthMatch": TELE, "languageMatch": LANG, "genderMatch": "(gen = 'any')"}
PO = {"concernsOverlap": ("con", "p_con", 0.5), "modalityOverlap": ("md", "p_mod", 0.5), "culturalOverlap": ("cul", "p_cul", 0.0)}


@query("pair_features_by_provider", "M27 C6 H17", f"""WITH {CATALOG_SQL}, s AS (SELECT provider_id, {', '.join(f'{e} AS "{n}"' for n, e in PF.items())},
  {', '.join(f'CASE WHEN len({a}) > 0 THEN round({OV.format(a, b)}, 3) ELSE {d} END AS "{n}"' for n, (a, b, d) in PO.items())} FROM req, cat)
SELECT provider_id, {', '.join(f'count(*) FILTER ("{n}") AS "{n}"' for n in PF)}, {', '.join(f'avg("{n}") AS "{n}"' for n in PO)} FROM s GROUP BY provider_id""", list(PO))
def q_pairf(spark, sf):
    pairs, f, p, _ = paired(spark, sf)
    s = pairs.select(F.col("p.provider_id").alias("provider_id"), "n", *match.pair_features(f, p))
    n = F.col("n")
    return s.groupBy("provider_id").agg(*[F.coalesce(F.sum(F.when(F.col(c), n)), F.lit(0)).alias(c) for c in PF],
                                        *[(F.sum(F.col(c) * n) / F.sum(n)).alias(c) for c in PO])


@query("provider_feature_totals", "M27 C6 H17", f"""WITH {CATALOG_SQL}, s AS (SELECT provider_id, {', '.join(f'{e} AS "{n}"' for n, e in PF.items())},
  {', '.join(f'CASE WHEN len({a}) > 0 THEN round({OV.format(a, b)}, 3) ELSE {d} END AS "{n}"' for n, (a, b, d) in PO.items())} FROM req, cat)
SELECT provider_id, {', '.join(f'count(*) FILTER ("{n}") AS "{n}"' for n in PF)}, {', '.join(f'avg("{n}") AS "{n}"' for n in PO)} FROM s GROUP BY provider_id""", list(PO))
def q_feature_totals(spark, sf):
    """The same totals from inverted lists, no pair formed."""
    return catalog_search.feature_totals(requests(spark, sf), catalog(spark, sf))


@query("softmax_margin", "H16", f"""WITH {SCORES}, s AS (SELECT id, max(score) FILTER ("class" = 'crisis') AS a, max(score) FILTER ("class" = 'recovery') AS b, max(score) FILTER ("class" = 'neither') AS c FROM scores GROUP BY id),
e AS (SELECT id, exp((a - greatest(a,b,c)) / 0.1) AS x, exp((b - greatest(a,b,c)) / 0.1) AS y, exp((c - greatest(a,b,c)) / 0.1) AS z FROM s)
SELECT id, list_reverse_sort([x,y,z])[1] / (x+y+z) AS confidence, (list_reverse_sort([x,y,z])[1] - list_reverse_sort([x,y,z])[2]) / (x+y+z) AS margin FROM e""", "confidence margin")
def q_softmax(spark, sf):
    wide = v.scores(spark, sf).groupBy("id").pivot("class", LABELS).agg(F.max("score"))
    probs = sc.softmax([F.col(c) for c in LABELS], 0.1)
    top = F.sort_array(F.array(*probs), asc=False)
    return wide.select("id", top[0].alias("confidence"), (top[0] - top[1]).alias("margin"))

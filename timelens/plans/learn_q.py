"""Feature matrix, cross-validated models, resampling, TF-IDF, ridge, encoder and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MATCH_FEATURES, STYLE, TEMPORAL
from ..learn import crossval, encode, folds, many, models, resample, ridge, tfidf
from ..operators import linguistic, matrix, metrics, ranking, semantic, style, temporal, zscore
from ..session import materialize, shared_dir
from ..sources import tables
from ..sources.keyed import KeyedTable
from ..streaming import ingest
from . import views as v
from .metrics_q import FAIR_SQL, FEATS, features
from .registry import query
from .sources_q import INTER, interaction_json
from .timeline import STY, TEMP, delta_cols, deltas_sql, window_cols
from .views import INTERACTIONS, LABELS as LABELS_SQL
from .views import POSTS, SCORES

once = v.once


def user_matrix(spark, sf):
    """Labelled authors with the temporal family (42 features)."""
    def make():
        labels = v.labels(spark, sf)
        return matrix.with_metadata(temporal.temporal_features(v.posts(spark, sf), labels, v.UNIT), labels)
    return once(spark, sf, "user_matrix", make)


T_COLS = window_cols(TEMPORAL) + delta_cols(TEMPORAL)
S_COLS = window_cols(STYLE) + delta_cols(STYLE)
TSQL = f"(WITH {TEMP} SELECT *, {deltas_sql(TEMPORAL)} FROM wide)"
SSQL = f"(WITH {STY} SELECT *, {deltas_sql(STYLE)} FROM wide)"


@query("family_join", "C2 B14", f"SELECT * FROM {TSQL} t JOIN {SSQL} s USING (author)", T_COLS + S_COLS)
def q_family(spark, sf):
    labels, posts = v.labels(spark, sf), v.posts(spark, sf)
    base = matrix.with_metadata(temporal.temporal_features(posts, labels, v.UNIT), labels)
    sty = matrix.with_metadata(style.style_features(posts, labels, v.UNIT, i_words=v.FIRST, we_words=v.WE, you_words=v.YOU), labels)
    joined = matrix.join_families(base, [sty])
    return joined.select("author", *matrix.select_family(joined))


@query("kitchen_sink_matrix", "C2 B13 B14 D13 D16 D20 D27")
def q_sink(spark, sf):
    """Raw, z-score, temporal and semantic families side by side: 121 features and metadata."""
    labels, posts, lex = v.labels(spark, sf), v.posts(spark, sf), v.lexicon(spark, sf)
    facts, kinds = zscore.shared_facts(posts, labels, lex, v.UNIT, v.FIRST, v.NEGATIVE)
    windows = materialize(linguistic.windows_from(facts, kinds, v.UNIT), "linguistic")
    raw = matrix.with_metadata(matrix.presence_flags(linguistic.add_deltas(windows, matrix.LINGUISTIC)), labels)
    z = zscore.zscores(windows, zscore.bucket_stats(zscore.buckets_from(facts, kinds, v.UNIT)))
    tmp = temporal.temporal_features(posts, labels, v.UNIT)
    sem = semantic.semantic_features(posts, labels, v.post_embeddings(spark, sf), v.UNIT)
    return matrix.join_families(raw, [z, tmp, sem])


@query("delta_family", "B14 B13", f"""WITH x AS {TSQL} SELECT author, {', '.join(f'"{c}"' for c in delta_cols(TEMPORAL))} FROM x""", delta_cols(TEMPORAL))
def q_delta(spark, sf):
    m = user_matrix(spark, sf)
    return m.select("author", *matrix.select_family(m, "deltas"))


FILLED_SQL = f"""x AS {TSQL}, md AS (SELECT {', '.join(f'median("{c}") AS "{c}"' for c in T_COLS)} FROM x),
m AS (SELECT [{', '.join(f'CAST(coalesce(x."{c}", md."{c}") AS DOUBLE)' for c in T_COLS)}] AS l, [{', '.join(f'CAST(x."{c}" AS DOUBLE)' for c in T_COLS)}] AS raw FROM x, md),
nm AS (SELECT [{', '.join(f"'{c}'" for c in T_COLS)}] AS n),
st AS (SELECT range AS i, var_pop(l[range + 1]) AS v, coalesce(var_samp(raw[range + 1]), 0) AS raw FROM m, range({len(T_COLS)}) GROUP BY 1),
pr AS (SELECT a.i AS i, b.i AS j, a.raw AS ra, b.raw AS rb, least(a.v, b.v) AS v, corr(l[a.i + 1], l[b.i + 1]) AS r FROM m, st a, st b
  WHERE a.i < b.i AND a.v > 0 AND b.v > 0 GROUP BY ALL)"""


@query("correlation_matrix", "D57", f"WITH {FILLED_SQL} SELECT n[i + 1] AS a, n[j + 1] AS b, r FROM pr, nm", "r")
def q_corr(spark, sf):
    return ridge.correlations(ridge.median_filled(user_matrix(spark, sf).select(*T_COLS), T_COLS), T_COLS)


@query("redundant_feature_filter", "M13", f"""WITH {FILLED_SQL}, gone AS (SELECT CASE WHEN rb >= ra THEN i ELSE j END AS i FROM pr WHERE v > 1e-6 AND abs(r) > 0.95)
SELECT n[i + 1] AS feature, v IS NOT NULL AND v > 1e-6 AND i NOT IN (SELECT i FROM gone) AS kept FROM st, nm""")
def q_redundant(spark, sf):
    """All 42 features: those that vary and are not a near copy of a more variable one."""
    kept = ridge.drop_redundant(user_matrix(spark, sf).select(*T_COLS), T_COLS)
    return spark.createDataFrame([(c, c in kept) for c in T_COLS], "feature string, kept boolean")


# ------------------------------------------------------------------ folds and models
@query("stratified_folds", "M1", f"""WITH {POSTS}, {LABELS_SQL}
SELECT author, CAST((row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(author || ':42'), 1, 15) AS BIGINT), author) - 1) % 5 AS INTEGER) AS fold FROM labels_t""")
def q_folds(spark, sf):
    return folds.assign_folds(v.labels(spark, sf))


def oof(spark, sf, name, fit):
    return once(spark, sf, f"oof_{name}", lambda: crossval.out_of_fold(user_matrix(spark, sf), T_COLS, fit))


def oof_lr(spark, sf):
    return oof(spark, sf, "lr", models.logistic())


def oof_rf(spark, sf):
    return oof(spark, sf, "rf", models.forest())


@query("oof_logistic_regression", "M3 M6 U4")
def q_lr(spark, sf):
    return oof_lr(spark, sf)


@query("oof_random_forest", "M4 M6")
def q_rf(spark, sf):
    return oof_rf(spark, sf)


@query("oof_boosted_trees", "M5 M6")
def q_gbt(spark, sf):
    return crossval.out_of_fold(user_matrix(spark, sf), T_COLS, models.boosted(iterations=20))


FOLD_SQL = "CAST((row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(author || ':42'), 1, 15) AS BIGINT), author) - 1) % 5 AS INTEGER)"


@query("oof_coverage", "M3 M4 M6", f"""WITH {POSTS}, {LABELS_SQL}, f AS (SELECT author, label, {FOLD_SQL} AS fold FROM labels_t)
SELECT model, label, fold, count(*) AS authors, 3 * count(*) AS scores, count(*)::DOUBLE AS probability, true AS all_between FROM f, (VALUES ('lr'), ('rf')) m(model) GROUP BY 1, 2, 3""", "probability")
def q_oof_coverage(spark, sf):
    """Every author is scored once, in their own fold, with probabilities of all classes that sum to one."""
    tables_ = [t(spark, sf).withColumn("model", F.lit(n)) for n, t in (("lr", oof_lr), ("rf", oof_rf))]
    return tables_[0].unionByName(tables_[1]).groupBy("model", "label", "fold").agg(
        F.count_distinct("author").alias("authors"), F.count("score").alias("scores"), F.sum("score").alias("probability"),
        F.bool_and(F.col("score").between(0, 1)).alias("all_between"))


@query("stacked_models", "M7 M6")
def q_stack(spark, sf):
    return crossval.stack({"lr": oof_lr(spark, sf), "rf": oof_rf(spark, sf)}, models.logistic(c=1.0))


@query("grid_search", "M9")
def q_grid(spark, sf):
    return crossval.search(user_matrix(spark, sf), T_COLS, crossval.grid(c=[0.1, 0.5, 3.0]), models.logistic)


@query("random_search", "M10")
def q_random(spark, sf):
    space = crossval.random_space(5, trees=(10, 30, "int"), depth=(3, 6, "int"), min_leaf=(1, 5, "int"))
    return crossval.search(user_matrix(spark, sf), T_COLS, space, models.forest)


@query("feature_importance", "M12 F3 E5")
def q_importance(spark, sf):
    return crossval.importance(user_matrix(spark, sf), T_COLS, models.forest())


@query("permutation_test", "M17")
def q_perm(spark, sf):
    """A thousand permutations, fitted as columns of one design."""
    return many.permutation_test(crossval.with_folds(user_matrix(spark, sf)), T_COLS, permutations=1000)


@query("penalty_search", "M9")
def q_penalty(spark, sf):
    """Thirteen penalties and all their folds in the same passes."""
    return many.penalty_search(crossval.with_folds(user_matrix(spark, sf)), T_COLS, [10.0 ** (e / 3) for e in range(-6, 7)])


@query("permuted_labels", "M17", f"""WITH {POSTS}, {LABELS_SQL},
a AS (SELECT author, row_number() OVER (ORDER BY CAST('0x' || substr(md5(author || ':a42'), 1, 15) AS BIGINT), author) AS pos FROM labels_t),
b AS (SELECT label, row_number() OVER (ORDER BY CAST('0x' || substr(md5(author || ':b42'), 1, 15) AS BIGINT), author) AS pos FROM labels_t)
SELECT author, label FROM a JOIN b USING (pos)""")
def q_permuted(spark, sf):
    return crossval.permuted_labels(v.labels(spark, sf).select("author", "label"), 42).select("author", "label")


@query("experiment_metrics", "M29 U5 D41 D42 D43")
def q_experiment(spark, sf):
    return crossval.run_experiment(spark, "temporal", user_matrix(spark, sf), ["lr", "rf", "nonesuch"])


# ------------------------------------------------------------------ resampling
def poisson_sql(key, rep, seed):
    """Weight of a row in a replicate: Poisson(1) by inversion of a cubic polynomial in the replicate, modulo a prime."""
    p = resample.PRIME
    c = [f"(CAST('0x' || substr(md5({key} || ':{seed}'), {1 + 8 * i}, 8) AS BIGINT) % {p})" for i in range(4)]
    u = c[0]
    for x in c[1:]:
        u = f"(({u} * ({rep} + 1) % {p} + {x}) % {p})"
    return f"(SELECT {' + '.join(f'CASE WHEN u >= {t} THEN 1 ELSE 0 END' for t in resample.REACHED)} FROM (SELECT {u} AS u))"


B = 2000
DRAWS = f"""dr0 AS (SELECT id, label, r.range AS replicate FROM (SELECT DISTINCT id, label FROM scores), range({B}) r),
dr AS (SELECT * FROM (SELECT *, {poisson_sql('id', 'replicate', 42)} AS w FROM dr0) WHERE w > 0)"""


def boot_auc(name, score):
    return f"""{name}0 AS (SELECT replicate, s."class", {score} AS score, sum(CASE WHEN s.label = s."class" THEN w ELSE 0 END)::DOUBLE AS pos,
  sum(CASE WHEN s.label <> s."class" THEN w ELSE 0 END)::DOUBLE AS neg FROM dr JOIN scores s USING (id) GROUP BY ALL),
{name}1 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate, "class" ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}0),
{name} AS (SELECT replicate, avg(auc) AS auc FROM (SELECT replicate, "class", sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM {name}1 GROUP BY 1, 2) GROUP BY 1)"""


BOOT_F1 = """bf0 AS (SELECT replicate, c.cls, sum(CASE WHEN p.label = c.cls AND prediction = c.cls THEN w ELSE 0 END)::DOUBLE AS tp,
  sum(CASE WHEN p.label = c.cls THEN w ELSE 0 END)::DOUBLE AS sup, sum(CASE WHEN prediction = c.cls THEN w ELSE 0 END)::DOUBLE AS pre
  FROM dr JOIN preds p USING (id), (VALUES ('crisis'), ('recovery'), ('neither')) c(cls) GROUP BY 1, 2),
bf AS (SELECT replicate, avg(CASE WHEN tp > 0 THEN 2 * tp / (sup + pre) ELSE 0.0 END) AS f1 FROM bf0 GROUP BY 1)"""


def summary_sql(c):
    return (f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, quantile_cont({c}, 0.025) AS {c}_low, "
            f"quantile_cont({c}, 0.975) AS {c}_high, count(*) FILTER ({c} IS NULL) AS {c}_degenerate")


@query("bootstrap_metrics", "M15", f"""WITH {SCORES}, {DRAWS}, {boot_auc('ba', 's.score')}, {BOOT_F1}
SELECT count(*) AS replicates, {summary_sql('auc')}, {summary_sql('f1')} FROM ba JOIN bf USING (replicate)""",
       [f"{m}_{s}" for m in ("auc", "f1") for s in ("mean", "std", "low", "high")])
def q_boot(spark, sf):
    return resample.bootstrap_metrics(v.scores(spark, sf), B)


@query("paired_bootstrap", "M16", f"""WITH {SCORES}, {DRAWS}, {boot_auc('ba', 's.score')}, {boot_auc('bb', '(s.score * 1000) % 7')},
d AS (SELECT ba.auc - bb.auc AS delta FROM ba JOIN bb USING (replicate)), o AS (SELECT avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM d)
SELECT count(delta) AS replicates, avg(delta) AS mean_delta, stddev_samp(delta) AS std_delta, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high,
  (SELECT p FROM o) AS p_one, (SELECT 2 * least(p, 1 - p) FROM o) AS p_two FROM d""", "mean_delta std_delta low high p_one p_two")
def q_paired(spark, sf):
    a = v.scores(spark, sf)
    return resample.paired_bootstrap(a, a.withColumn("score", (F.col("score") * 1000) % 7), B)


GM = T_COLS


@query("bootstrap_group_means", "M18", f"""WITH {POSTS}, {LABELS_SQL}, x AS {TSQL},
l AS (SELECT label, author, f.w AS feature, CASE f.w {' '.join(f"WHEN '{c}' THEN {c}" for c in GM)} END AS val FROM x JOIN labels_t USING (author), (VALUES {', '.join(f"('{c}')" for c in GM)}) f(w)),
r AS (SELECT *, {poisson_sql('author', 'replicate', 42)} AS k FROM (SELECT l.*, range AS replicate FROM l, range({B}) WHERE val IS NOT NULL)),
gm AS (SELECT label, feature, replicate, sum(k * val) / sum(k) AS gmean FROM r WHERE k > 0 GROUP BY 1, 2, 3),
ci AS (SELECT label, feature, quantile_cont(gmean, 0.025) AS low, quantile_cont(gmean, 0.975) AS high FROM gm GROUP BY 1, 2)
SELECT label, feature, count(val) AS n, avg(val) AS mean, CASE WHEN count(val) < 2 THEN avg(val) ELSE any_value(low) END AS low,
  CASE WHEN count(val) < 2 THEN avg(val) ELSE any_value(high) END AS high FROM l LEFT JOIN ci USING (label, feature) WHERE val IS NOT NULL GROUP BY 1, 2""", "mean low high")
def q_groupci(spark, sf):
    long = user_matrix(spark, sf).unpivot(["author", "label"], GM, "feature", "value")
    return resample.bootstrap_group_means(long, ["label", "feature"], "value", "author", B)


# ------------------------------------------------------------------ TF-IDF
TFIDF_SQL = f"""{POSTS},
td AS (SELECT author, created_utc, id, lower(coalesce(title,'') || ' ' || coalesce(body,'')) AS text FROM posts),
wt AS (SELECT author, created_utc, id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}') AS t FROM td),
ut AS (SELECT author, created_utc, id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM wt),
bt AS (SELECT author, lag(term) OVER (PARTITION BY author ORDER BY created_utc, id, pos) || ' ' || term AS term FROM ut),
wc AS (SELECT author, term, count(*) AS tf FROM (SELECT author, term FROM ut UNION ALL SELECT author, term FROM bt WHERE term IS NOT NULL) GROUP BY 1, 2),
cw AS (SELECT author, ' ' || w || ' ' AS w, n FROM (SELECT author, unnest(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}]+')) AS w, count(*) AS n FROM td GROUP BY 1, 2) WHERE length(w) > 0),
cc AS (SELECT author, term, sum(n)::BIGINT AS tf FROM (SELECT author, n, unnest(list_transform(range(1, length(w) - k.k + 2), lambda i: substr(w, i, k.k))) AS term
  FROM cw, (VALUES (3), (4), (5)) k(k) WHERE length(w) >= k.k) GROUP BY 1, 2),
ac AS (SELECT 'word' AS block, * FROM wc UNION ALL SELECT 'char', * FROM cc),
nd AS (SELECT count(DISTINCT author) AS n FROM posts),
vo AS (SELECT block, term, count(*) AS df, ln((1.0 + (SELECT n FROM nd)) / (1.0 + count(*))) + 1.0 AS idf FROM ac GROUP BY 1, 2 HAVING count(*) >= 3
  QUALIFY row_number() OVER (PARTITION BY block ORDER BY sum(tf) DESC, term) <= 20000),
rw AS (SELECT block, author, term, df, idf, (1.0 + ln(tf)) * idf AS x FROM ac JOIN vo USING (block, term)),
tw AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY block, author)) AS weight FROM rw)"""


@query("tfidf_terms", "M11", f"WITH {TFIDF_SQL} SELECT block, term, max(df) AS df, max(idf) AS idf, count(*) AS authors, sum(weight) AS weight FROM tw GROUP BY 1, 2", "idf weight")
def q_tfidf(spark, sf):
    t = tfidf.tfidf(v.posts(spark, sf))
    return t.groupBy("block", "term").agg(F.max("df").alias("df"), F.max("idf").alias("idf"), F.count(F.lit(1)).alias("authors"), F.sum("weight").alias("weight"))


def oof_tfidf(spark, sf):
    """Scores of authors from their words alone; vocabulary and model from the other folds."""
    def make():
        counts = tfidf.term_counts(v.posts(spark, sf))
        return crossval.out_of_fold(user_matrix(spark, sf).select("author", "label"), [], tfidf.channel(counts))
    return once(spark, sf, "oof_tfidf", make)


@query("oof_tfidf", "M3 M11")
def q_oof_tfidf(spark, sf):
    return oof_tfidf(spark, sf)


@query("stacked_tfidf_forest", "M7 M11")
def q_stack_tfidf(spark, sf):
    """The words' channel and the forest's, stacked."""
    return crossval.stack({"tfidf": oof_tfidf(spark, sf), "rf": oof_rf(spark, sf)}, models.logistic(c=1.0))


@query("tfidf_channel_coverage", "M7 M11", f"""WITH {POSTS}, {LABELS_SQL}, f AS (SELECT author, label, {FOLD_SQL} AS fold FROM labels_t)
SELECT model, label, fold, count(*) AS authors, 3 * count(*) AS scores, count(*)::DOUBLE AS probability, true AS all_between FROM f, (VALUES ('tfidf'), ('stack')) m(model) GROUP BY 1, 2, 3""", "probability")
def q_tfidf_coverage(spark, sf):
    """Every author has scores of the words' channel and of the stack, in their own fold."""
    both = oof_tfidf(spark, sf).withColumn("model", F.lit("tfidf")).unionByName(q_stack_tfidf(spark, sf).withColumn("model", F.lit("stack")))
    return both.groupBy("model", "label", "fold").agg(F.count_distinct("author").alias("authors"), F.count("score").alias("scores"),
                                                      F.sum("score").alias("probability"), F.bool_and(F.col("score").between(0, 1)).alias("all_between"))


# ------------------------------------------------------------------ encoder
@query("encoded_posts", "M25 U6", f"""WITH {POSTS}, t AS (SELECT id, lower(coalesce(title,'') || ' ' || coalesce(body,'')) AS text FROM posts),
c AS (SELECT id, i.i AS dim, length(text) - length(replace(text, chr(97 + i.i::INTEGER), '')) AS n FROM t, range(26) i(i))
SELECT id, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS x FROM c""", "x")
def q_encode(spark, sf):
    """Posts without a cached vector are encoded; the cache holds the posts below a score of 20."""
    posts = v.posts(spark, sf)
    # A cache is a written table: its vectors are made once and then only read.
    cached = materialize(encode.encode_posts(posts.filter("score < 20")), "cached_vectors")
    out = encode.encode_missing(posts, cached, encode.first_available([_missing_model, encode.letter_encoder]))
    return out.select("id", F.posexplode("embedding").alias("dim", "x")).select(
        "id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


def _missing_model():
    raise ImportError("no model in this environment")


# ------------------------------------------------------------------ ridge
def ridge_input(spark, sf):
    return once(spark, sf, "ridge", lambda: features(spark, sf).filter("y is not null").select("id", "y", *MATCH_FEATURES))


NAMES = ["one", *MATCH_FEATURES, "y"]


@query("ridge_sufficient_statistics", "M20", f"""WITH {INTERACTIONS}, {FEATS}, z AS (SELECT [{', '.join(f'CAST({c} AS DOUBLE)' for c in ['1.0', *NAMES[1:]])}] AS x FROM fx)
SELECT CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j, sum(x[i.range + 1] * x[j.range + 1]) AS value
FROM z, range({len(NAMES)}) i, range({len(NAMES)}) j WHERE j.range >= i.range GROUP BY 1, 2""", "value")
def q_gram(spark, sf):
    """All second moments of the features, the constant and the target."""
    return ridge.gram(ridge_input(spark, sf), [*MATCH_FEATURES, "y"])


@query("bayesian_ridge_predictions", "M20")
def q_ridge(spark, sf):
    df = ridge_input(spark, sf)
    m = ridge.fit_ridge(df, MATCH_FEATURES)
    return df.select("id", "y", m.predict().alias("p"), m.deviation().alias("std"))


@query("ranked_ridge_model", "M21 M19 M22")
def q_ranked(spark, sf):
    df = ridge_input(spark, sf)
    m, kind = ridge.fit_ranked(df, MATCH_FEATURES)
    w = dict(zip(m.features, (float(x) for x in m.coef)))
    stats = {c: (float(a), float(b)) for c, a, b in zip(m.features, m.mean, m.scale)}
    return ranking.attribution_summary(ranking.attributions(df, w, stats), w).withColumn("model", F.lit(kind))


@query("ridge_cross_validation", "M21")
def q_ridge_cv(spark, sf):
    return ridge.cross_validate(ridge_input(spark, sf), MATCH_FEATURES)


@query("uncertainty_calibration", "D55", "SELECT avg(value / 500) AS mean_std, stddev_pop(value / 500) AS std_of_std FROM events", "mean_std std_of_std")
def q_cal(spark, sf):
    return metrics.calibration(v.table(spark, sf, "events").withColumn("std", F.col("value") / 500), "std")


@query("run_log", "A11 D52 D54", f"""WITH {INTERACTIONS}, {FAIR_SQL}, e AS (SELECT count(*) AS samples, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae FROM ix),
r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM ix),
o AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS got, row_number() OVER (ORDER BY y DESC, id) AS best FROM ix),
g AS (SELECT sum(CASE WHEN got <= 5 THEN (2 ** y - 1) / log2(got + 1) END) AS dcg, sum(CASE WHEN best <= 5 THEN (2 ** y - 1) / log2(best + 1) END) AS idcg FROM o),
m AS (SELECT "group", max(mean_pred) - min(mean_pred) AS gap FROM fair GROUP BY 1)
SELECT range + 1 AS run, 'plain' AS model_type, samples, {len(MATCH_FEATURES)} AS features, round(rmse, 5) AS rmse, round(mae, 5) AS mae,
  (SELECT round(corr(a, b), 5) FROM r) AS spearman, (SELECT round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 1 END, 5) FROM g) AS ndcg5,
  (SELECT substr(md5('[' || string_agg(CAST(y AS VARCHAR), ', ' ORDER BY id) || ']'), 1, 8) FROM ix) AS data_hash,
  (SELECT count(*) FROM m WHERE round(gap, 4) > 0.15) AS fairness_flags FROM e, range(3)""", "rmse mae spearman ndcg5")
def q_runs(spark, sf):
    """Three runs of one log; the time of training is left out of the comparison."""
    path = shared_dir(spark, "runs")
    run = materialize(ranking.run_record(v.interactions(spark, sf), "plain", len(MATCH_FEATURES)), "run")
    for _ in range(3):
        log = tables.append_run(spark, path, run)
    return log.drop("trained_at")


# ------------------------------------------------------------------ streaming
@query("stream_interactions", "S1 A10", f"""WITH {INTER}, g AS (SELECT type, pid AS provider_id, coalesce(ins, '') AS insurance, concerns FROM inter WHERE event_id % 50 <> 0)
SELECT 'row' AS kind, type, insurance, count(*) AS n, CAST(sum(length(concerns)) AS BIGINT) AS chars FROM g GROUP BY 2, 3
UNION ALL SELECT 'reject', '', '', count(*), NULL FROM inter WHERE event_id % 50 = 0""")
def q_stream(spark, sf):
    """One line in fifty is broken JSON and lands in the rejects."""
    root = shared_dir(spark, "stream")
    lines = interaction_json(spark, sf).select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.mode("overwrite").text(f"{root}/in")
    q = ingest.ingest_events(spark, f"{root}/in", f"{root}/out", f"{root}/bad", f"{root}/chk")
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/out").groupBy("type", "insurance").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("concerns")).alias("chars"))
    bad = spark.read.parquet(f"{root}/bad").agg(F.count(F.lit(1)).alias("n"))
    return (rows.select(F.lit("row").alias("kind"), "type", "insurance", "n", "chars").unionByName(
        bad.select(F.lit("reject").alias("kind"), F.lit("").alias("type"), F.lit("").alias("insurance"), "n", F.lit(None).cast("long").alias("chars"))))


COLLECT = f"WITH {POSTS} SELECT author, id, created_utc FROM posts"


def landed_twice(spark, sf, root):
    """Posts landed in files, many of them in two files, new ones before old ones."""
    posts = v.posts(spark, sf).select("author", "id", "created_utc")
    # Files are out of order in time: each holds ids of all days.
    posts.repartition(8, "id").write.mode("overwrite").parquet(f"{root}/in")
    posts.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == 0).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")


@query("stream_collect_exact", "S2 A3", COLLECT)
def q_collect(spark, sf):
    root = shared_dir(spark, "collect")
    ingest.collect_exact(spark, landed_twice(spark, sf, root), f"{root}/out", f"{root}/chk").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("author", "id", "created_utc")


@query("stream_collect_keyed", "S2 A3", COLLECT)
def q_collect_keyed(spark, sf):
    root = shared_dir(spark, "collect")
    posts = landed_twice(spark, sf, root)
    table = KeyedTable(spark, f"{root}/table", posts.schema, "id", split_rows=100_000)
    ingest.collect_keyed(posts, table, f"{root}/chk").awaitTermination()
    return table.read().select("author", "id", "created_utc")


@query("stream_collect_watermark", "S2", COLLECT)
def q_watermark(spark, sf):
    root = shared_dir(spark, "dedup")
    ingest.collect_stream(landed_twice(spark, sf, root), f"{root}/out", f"{root}/chk").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("author", "id", "created_utc")



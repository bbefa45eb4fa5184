"""Embedding, verification, weekly series, weekly sequence and change-point queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LABELS as CLASSES
from ..constants import PRE_WINDOWS, VERIFY_MAX_POSTS, VERIFY_MIN_POSTS, WINDOWS
from ..functions import vector as vec
from ..operators import changepoint, clean, reports, semantic, weekly
from . import views as v
from .registry import query
from .views import AGED, FACTS, LABELS, POSTS

DIMS = 64
EMB = """emb AS (SELECT concat('e', event_id) AS id, i.i - 1 AS dim, embedding[i.i]::DOUBLE AS x
  FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings), range(1, 65) i(i))"""
CENT = f"""{POSTS}, {LABELS}, {AGED}, {EMB},
cent AS (SELECT author, dim, {', '.join(f"avg(x) FILTER (w = '{w}') AS {w}" for w in WINDOWS)} FROM inwin JOIN emb USING (id) GROUP BY author, dim)"""


@query("posts_with_vectors", "C4", f"""WITH {POSTS}, {EMB} SELECT author, id, sum(x) AS total FROM posts JOIN emb USING (id) GROUP BY 1, 2""", "total")
def q_join(spark, sf):
    joined = semantic.with_vectors(v.posts(spark, sf).select("author", "id"), v.post_embeddings(spark, sf))
    return joined.select("author", "id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


@query("window_centroids", "D26", f"WITH {CENT} SELECT * FROM cent WHERE coalesce({', '.join(WINDOWS)}) IS NOT NULL", WINDOWS)
def q_cent(spark, sf):
    cent = semantic.window_centroids(v.posts(spark, sf), v.labels(spark, sf), v.post_embeddings(spark, sf), v.UNIT)
    return cent.filter(F.coalesce(*WINDOWS).isNotNull()).withColumn("dim", F.col("dim").cast("long"))


@query("semantic_shift", "D27 H15", f"""WITH {CENT}
SELECT l.author, {', '.join(f"CASE WHEN sum(baseline*baseline) > 0 AND sum({w}*{w}) > 0 THEN sum(baseline*{w}) / (sqrt(sum(baseline*baseline)) * sqrt(sum({w}*{w}))) END AS cos_sim_{w}, sqrt(sum((baseline-{w})*(baseline-{w}))) AS l2_dist_{w}" for w in PRE_WINDOWS)}
FROM labels_t l LEFT JOIN cent c USING (author) GROUP BY l.author""", [f"{m}_{w}" for w in PRE_WINDOWS for m in ("cos_sim", "l2_dist")])
def q_shift(spark, sf):
    return semantic.semantic_features(v.posts(spark, sf), v.labels(spark, sf), v.post_embeddings(spark, sf), v.UNIT)


def _long(df):
    return df.select("author", F.posexplode("embedding").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))


@query("user_mean_vectors", "D28", f"""WITH {POSTS}, {LABELS}, {EMB} SELECT author, dim, avg(x) AS x FROM posts JOIN emb USING (id)
WHERE author IN (SELECT author FROM labels_t) GROUP BY 1, 2""", "x")
def q_uvec(spark, sf):
    cells = semantic.mean_cells(v.posts(spark, sf), v.post_embeddings(spark, sf))
    return _long(semantic.user_vectors(v.labels(spark, sf), cells, DIMS))


@query("user_window_vectors", "D28", f"""WITH {CENT}, s AS (SELECT * FROM (VALUES ('baseline', 0), ('pre_4w', 1), ('pre_2w', 2), ('pre_1w', 3)) s(w, slot))
SELECT l.author, slot * 64 + d.d AS dim, coalesce(CASE w {' '.join(f"WHEN '{w}' THEN {w}" for w in WINDOWS)} END, 0.0) AS x
FROM labels_t l CROSS JOIN s CROSS JOIN range(64) d(d) LEFT JOIN cent c ON c.author = l.author AND c.dim = d.d""", "x")
def q_wvec(spark, sf):
    labels = v.labels(spark, sf)
    cent = semantic.window_centroids(v.posts(spark, sf), labels, v.post_embeddings(spark, sf), v.UNIT)
    return _long(semantic.window_vectors(labels, cent, DIMS))


@query("vector_arithmetic", "H15", """
WITH c AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a
  JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))
SELECT vec_id, list_dot_product(a, b) AS dot, sqrt(list_dot_product(a, a)) AS norm, list_cosine_similarity(a, b) AS cosine,
  list_distance(a, b) AS l2, list_extract(a, 1) / sqrt(list_dot_product(a, a)) AS unit_first FROM c""", "dot norm cosine l2 unit_first")
def q_vec(spark, sf):
    emb = v.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = emb.select((F.pmod(F.col("vec_id") - 1, v.row_count(emb))).alias("vec_id"), F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    return emb.join(nxt, "vec_id").select("vec_id", vec.dot(a, b).alias("dot"), vec.norm(a).alias("norm"), vec.cosine(a, b).alias("cosine"),
                                          vec.l2_distance(a, b).alias("l2"), F.element_at(vec.unit(a), 1).alias("unit_first"))


# ------------------------------------------------------------------ verification by prototypes
VERIFY = f"""{POSTS}, {LABELS}, {EMB},
proto0 AS (SELECT (['crisis', 'recovery', 'neither'])[label + 1] AS cls, i.i - 1 AS dim, avg(embedding[i.i]::DOUBLE) AS m FROM embeddings, range(1, 65) i(i)
  WHERE label < 3 GROUP BY 1, 2),
proto AS (SELECT cls, dim, m / (sqrt(sum(m * m) OVER (PARTITION BY cls)) + 1e-8) AS p FROM proto0),
un AS (SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM emb),
use0 AS (SELECT author, id, created_utc FROM posts
  WHERE length(regexp_replace(coalesce(title,'') || ' ' || coalesce(body,''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) > 10),
usable AS (SELECT author, id FROM use0 QUALIFY count(*) OVER (PARTITION BY author) >= {VERIFY_MIN_POSTS}
  AND row_number() OVER (PARTITION BY author ORDER BY created_utc, id) <= {VERIFY_MAX_POSTS}),
uv AS (SELECT author, dim, avg(x) AS m FROM usable JOIN un USING (id) GROUP BY 1, 2),
un2 AS (SELECT author, dim, m / (sqrt(sum(m * m) OVER (PARTITION BY author)) + 1e-8) AS m FROM uv),
sims AS (SELECT author, sum(m * p) FILTER (cls = 'crisis') AS sim_crisis, sum(m * p) FILTER (cls = 'recovery') AS sim_recovery,
         sum(m * p) FILTER (cls = 'neither') AS sim_neither FROM un2 JOIN proto USING (dim) GROUP BY author),
ex AS (SELECT *, greatest(sim_crisis, sim_recovery, sim_neither) AS mx FROM sims),
pr0 AS (SELECT *, exp((sim_crisis - mx) * 10) AS e1, exp((sim_recovery - mx) * 10) AS e2, exp((sim_neither - mx) * 10) AS e3 FROM ex),
pr AS (SELECT author, sim_crisis, sim_recovery, sim_neither, e1/(e1+e2+e3) AS p1, e2/(e1+e2+e3) AS p2, e3/(e1+e2+e3) AS p3 FROM pr0),
ver0 AS (SELECT *, list_reverse_sort([p1, p2, p3]) AS ps, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'crisis' WHEN p2 >= p3 THEN 'recovery' ELSE 'neither' END AS content_label FROM pr),
ver AS (SELECT v.author, l.label, content_label, ps[1] AS confidence, ps[1] - ps[2] AS margin, sim_crisis, sim_recovery, sim_neither,
         content_label = l.label AND ps[1] - ps[2] >= 0.02 AS agrees, l.low_confidence OR NOT (content_label = l.label AND ps[1] - ps[2] >= 0.02) AS low_confidence
        FROM ver0 v JOIN labels_t l USING (author))"""


def similarities(spark, sf):
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("label") + 1)
    protos = semantic.class_prototypes(v.table(spark, sf, "embeddings").filter("label < 3").withColumn("class", name).select("class", "embedding")
                                       .withColumnRenamed("class", "c"), "c")
    posts = clean.usable_posts(v.posts(spark, sf), VERIFY_MIN_POSTS, VERIFY_MAX_POSTS)
    cells = semantic.mean_cells(posts, v.post_embeddings(spark, sf), unit_vectors=True)
    return semantic.prototype_similarity(cells, protos)


def verified(spark, sf, mode):
    labels = v.labels(spark, sf).select("author", "label", "low_confidence")
    return semantic.verify_labels(similarities(spark, sf), labels, mode).select(
        "author", "label", "content_label", "confidence", "margin", "sim_crisis", "sim_recovery", "sim_neither", "agrees", "low_confidence")


SIMS = "sim_crisis sim_recovery sim_neither"


@query("prototype_similarity", "C11", f"WITH {VERIFY} SELECT * FROM sims", SIMS)
def q_sims(spark, sf):
    return similarities(spark, sf)


@query("verify_labels_flag", "M23 H16", f"WITH {VERIFY} SELECT * FROM ver", "confidence margin " + SIMS)
def q_flag(spark, sf):
    return verified(spark, sf, "flag")


@query("verify_labels_drop", "M23", f"WITH {VERIFY} SELECT * FROM ver WHERE agrees", "confidence margin " + SIMS)
def q_drop(spark, sf):
    return verified(spark, sf, "drop")


@query("label_agreement", "D40", f"""WITH {VERIFY} SELECT coalesce(label, 'all') AS label, count(*) AS n, count(*) FILTER (agrees) AS agree,
avg(CASE WHEN agrees THEN 1.0 ELSE 0.0 END) AS rate FROM ver GROUP BY ROLLUP (label)""", "rate")
def q_agree(spark, sf):
    return semantic.agreement(verified(spark, sf, "flag"))


@query("tag_by_content_label", "D37", f"""WITH {VERIFY} SELECT label, count(*) FILTER (content_label = 'crisis') AS crisis,
count(*) FILTER (content_label = 'recovery') AS recovery, count(*) FILTER (content_label = 'neither') AS neither FROM ver GROUP BY label""")
def q_tagcontent(spark, sf):
    return reports.cross_tab(verified(spark, sf, "flag"), "label", "content_label", CLASSES)


# ------------------------------------------------------------------ weekly series
WEEK = "date_trunc('week', {} - INTERVAL 1 DAY) + INTERVAL 1 DAY"
SERIES = f"""{POSTS},
st AS (SELECT author, id, created_utc, {v.tokens_sql("trim(coalesce(title,'') || ' ' || coalesce(body,''))")} AS tokens FROM posts
  WHERE length(regexp_replace(coalesce(title,'') || coalesce(body,''), '[\\s\\p{{Z}}]+', '', 'g')) > 0),
sv AS (SELECT *, coalesce(list_sum(list_transform(tokens, lambda t: length(t) % 9 - 4)), 0)::DOUBLE AS val FROM st),
sc AS (SELECT author, id, created_utc, val / sqrt(val * val + 15.0) AS sentiment FROM sv),
wk AS (SELECT author, CAST({WEEK.format('created_utc')} AS TIMESTAMP) AS week, avg(sentiment) AS value FROM sc GROUP BY 1, 2),
gr AS (SELECT author, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM wk GROUP BY author),
ser AS (SELECT author, week, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY author ORDER BY week ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (PARTITION BY author ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM gr LEFT JOIN wk USING (author, week))"""


@query("weekly_sentiment_series", "D29 E3 H11 H14", f"WITH {SERIES} SELECT * FROM ser", "value")
def q_series(spark, sf):
    return weekly.weekly_series(weekly.post_scores(v.posts(spark, sf), v.lexicon(spark, sf)), "sentiment")


ORDERS = f"""ot AS (SELECT CAST(o_custkey AS VARCHAR) AS author, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS TIMESTAMP) AS created_utc, o_totalprice AS total FROM orders),
wk AS (SELECT author, CAST({WEEK.format('created_utc')} AS TIMESTAMP) AS week, avg(total) / 100000.0 AS value FROM ot GROUP BY 1, 2),
gr AS (SELECT author, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM wk GROUP BY author),
ser AS (SELECT author, week, last_value(value IGNORE NULLS) OVER (PARTITION BY author ORDER BY week ROWS UNBOUNDED PRECEDING) AS value
  FROM gr LEFT JOIN wk USING (author, week))"""


def order_series(spark, sf):
    """Real weeks with long gaps: weekly mean order value per customer."""
    return weekly.weekly_series(v.orders_timeline(spark, sf).withColumn("value", F.col("total") / 100000.0), "value")


@query("weekly_order_series", "D29 E3 H14", f"WITH {ORDERS} SELECT * FROM ser", "value")
def q_oseries(spark, sf):
    return order_series(spark, sf)


SEQ_COLS = weekly.SEQUENCE_FEATURES
SEQ = f"""{POSTS}, {LABELS}, {AGED}, {FACTS},
sl AS (SELECT s.*, 39 - (a.age - 1) // 86400000000 AS slot, len({v.case_tokens_sql('text')}) AS n_case
  FROM aged a JOIN scored s USING (id) WHERE a.age > 0 AND a.age <= 40 * 86400000000),
kd AS (SELECT author, slot, count(DISTINCT t) AS kinds FROM (SELECT author, slot, unnest(list_distinct(tokens)) AS t FROM sl) GROUP BY 1, 2),
sq AS (SELECT author, slot, avg(sentiment) AS sentiment, greatest(sum(n_tokens), 1)::DOUBLE AS tok, avg(n_case) AS avg_sent_len, count(*)::DOUBLE AS post_freq,
  sum(n_first)::DOUBLE AS fp, sum(n_negative)::DOUBLE AS neg, avg(n_tokens) AS avg_len FROM sl GROUP BY 1, 2),
seq AS (SELECT l.author, g.g AS slot, CASE WHEN q.author IS NULL THEN 0 ELSE 1 END AS mask, coalesce(sentiment, 0.0) AS sentiment,
  coalesce(CASE WHEN tok > 1 THEN coalesce(kinds, 0) / tok ELSE 0.0 END, 0.0) AS ttr, coalesce(avg_sent_len, 0.0) AS avg_sent_len, coalesce(post_freq, 0.0) AS post_freq,
  coalesce(fp / tok, 0.0) AS fp_rate, coalesce(neg / tok, 0.0) AS neg_rate, coalesce(avg_len, 0.0) AS avg_len
  FROM labels_t l CROSS JOIN range(40) g(g) LEFT JOIN sq q ON q.author = l.author AND q.slot = g.g LEFT JOIN kd k ON k.author = l.author AND k.slot = g.g)"""


def sequence(spark, sf):
    labels = v.labels(spark, sf)
    cells = weekly.sequence_cells(v.posts(spark, sf), labels, v.lexicon(spark, sf), v.FIRST, v.NEGATIVE, v.UNIT)
    return weekly.sequence_grid(cells, labels)


@query("weekly_sequence", "D32", f"WITH {SEQ} SELECT * FROM seq", SEQ_COLS)
def q_seq(spark, sf):
    return sequence(spark, sf)


@query("weekly_sequence_standardised", "D33", f"""WITH {SEQ},
ms AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) + 1e-6 AS s_{c}' for c in SEQ_COLS)} FROM seq WHERE mask = 1)
SELECT author, slot, mask, {', '.join(f'CASE WHEN mask = 1 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END AS {c}' for c in SEQ_COLS)} FROM seq, ms""", SEQ_COLS)
def q_seqstd(spark, sf):
    return weekly.standardise_sequence(sequence(spark, sf))


# ------------------------------------------------------------------ change points
def order_labels(spark, sf):
    """Customers labelled by their dearest order; its date is the turning point."""
    o = v.orders_timeline(spark, sf)
    pick = F.max(F.struct("total", "id", "created_utc", "title"))
    return o.groupBy("author").agg(pick.alias("m")).select(
        "author", F.when(F.col("m.title").startswith("1"), "crisis").otherwise("recovery").alias("label"),
        F.col("m.created_utc").alias("tp_date"))


@query("change_points", "M24")
def q_cps(spark, sf):
    cps = changepoint.change_points(order_series(spark, sf))
    return cps.select("author", "n_weeks", "n_cps", F.explode_outer("cp_weeks").alias("cp_week"))


# Given change points: a customer's first week of each calendar year after the first one.
GIVEN = """given AS (SELECT author, min(week) AS cp FROM ser GROUP BY author, year(week)),
cp AS (SELECT author, list(cp) AS cps FROM given WHERE (author, year(cp)) NOT IN (SELECT author, min(year(week)) FROM ser GROUP BY author) GROUP BY author),
nw AS (SELECT author, count(*) AS n_weeks FROM ser GROUP BY author HAVING count(*) >= 6),
best AS (SELECT author, created_utc AS tp_date, CASE WHEN o_orderpriority[1] = '1' THEN 'crisis' ELSE 'recovery' END AS label
  FROM (SELECT ot.*, o.o_orderpriority FROM ot JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = ot.id)
  QUALIFY row_number() OVER (PARTITION BY author ORDER BY total DESC, id DESC) = 1),
dist AS (SELECT author, label, n_weeks, coalesce(len(cps), 0) AS n_cps,
  CASE WHEN cps IS NULL THEN 'inf'::DOUBLE ELSE list_min(list_transform(cps, lambda c: abs(floor(date_diff('microsecond', tp_date, c) / 86400000000.0)))) / 7.0 END AS distance
  FROM nw JOIN best USING (author) LEFT JOIN cp USING (author))"""


def given_distances(spark, sf):
    ser = order_series(spark, sf)
    firsts = ser.groupBy("author", F.year("week").alias("y")).agg(F.min("week").alias("cp"))
    start = ser.groupBy("author").agg(F.min(F.year("week")).alias("y0"), F.count(F.lit(1)).alias("n_weeks")).filter("n_weeks >= 6")
    cps = (start.join(firsts, "author").groupBy("author", "n_weeks")
           .agg(F.collect_list(F.when(F.col("y") > F.col("y0"), F.col("cp"))).alias("cp_weeks"))
           .withColumn("n_cps", F.size("cp_weeks").cast("long")))
    return changepoint.nearest_distance(cps, order_labels(spark, sf))


@query("nearest_change_point", "C8", f"WITH {ORDERS}, {GIVEN} SELECT author, label, n_weeks, n_cps, CASE WHEN isinf(distance) THEN NULL ELSE distance END AS distance FROM dist", "distance")
def q_near(spark, sf):
    d = given_distances(spark, sf)
    return d.withColumn("distance", F.when(F.col("distance") != float("inf"), F.col("distance")))


RATES = ["mean_cps", "mean_weeks"] + [f"{p}_{k}" for k in (1, 2, 4) for p in ("hit_all", "hit_with_cp", "random")]


@query("change_point_hit_rates", "D30 D31", f"""WITH {ORDERS}, {GIVEN}
SELECT coalesce(label, 'all') AS label, count(*) AS n_users, count(*) FILTER (n_cps > 0) AS users_with_cp, avg(n_cps) AS mean_cps, avg(n_weeks) AS mean_weeks,
 {', '.join(f"avg(CASE WHEN distance <= {k} THEN 1.0 ELSE 0.0 END) AS hit_all_{k}, avg(CASE WHEN distance <= {k} THEN 1.0 ELSE 0.0 END) FILTER (NOT isinf(distance)) AS hit_with_cp_{k}, {2.0 * k} / avg(n_weeks) AS random_{k}" for k in (1, 2, 4))}
FROM dist GROUP BY ROLLUP (label)""", RATES)
def q_rates(spark, sf):
    return changepoint.hit_rates(given_distances(spark, sf))


@query("change_point_pipeline", "M24 C8 D30")
def q_cp_pipeline(spark, sf):
    """Detected change points of the order series, which has real weeks, and hit rates by the customers' labels."""
    return changepoint.hit_rates(changepoint.nearest_distance(changepoint.change_points(order_series(spark, sf)), order_labels(spark, sf)))

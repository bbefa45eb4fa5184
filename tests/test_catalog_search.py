import random

import pytest
from pyspark.sql import functions as F

from timelens.operators import catalog_search as cs
from timelens.operators import match

ASK = "id long, insurance string, ageGroup string, telehealth string, urgency string, language string, providerGender string, concerns array<string>, modalities array<string>, cultural array<string>"
GIVE = "provider_id long, insurance array<string>, ages array<string>, concerns array<string>, modalities array<string>, cultural array<string>, languages array<string>, telehealth boolean, crisis boolean"
INS, AGES, CON, MOD, CUL, LANG = ["bcbs", "cigna", "uninsured", "sliding_scale"], ["child", "teen", "adult"], ["a", "b", "c", "d"], ["x", "y"], ["u", "v"], ["english", "spanish"]


def tables(spark, n_req, n_prov, seed=0):
    rng = random.Random(seed)
    some = lambda xs: None if rng.random() < 0.05 else rng.sample(xs, rng.randint(0, len(xs)))
    reqs = [(i, rng.choice([*INS, "any", None]), rng.choice([*AGES, "any"]), rng.choice(["required", "preferred", "in_person", "any"]),
             rng.choice(["crisis", "urgent", "routine", "exploring"]), rng.choice([*LANG, "any"]), rng.choice(["woman", "any"]), some(CON), some(MOD), some(CUL)) for i in range(n_req)]
    provs = [(i * 7 % (n_prov + 1), some(INS), some(AGES), some(CON), some(MOD), some(CUL), some(LANG), rng.choice([True, False, None]), rng.choice([True, False])) for i in range(1, n_prov + 1)]
    return spark.createDataFrame(reqs, ASK), spark.createDataFrame(provs, GIVE)


def full(reqs, provs):
    pairs = match.beside_providers(reqs, provs)
    f = {c: F.col(c) for c in cs.ASKED}
    p = {c: F.col("p")[c] for c in cs.LISTING}
    return pairs, f, p


@pytest.mark.parametrize("fan,k,n", [(2, 1, 40), (3, 4, 60), (32, 5, 300), (2, 50, 20)])
def test_top_equals_all_pairs(spark, fan, k, n):
    reqs, provs = tables(spark, 60, n, fan)
    pairs, f, p = full(reqs, provs)
    want = {}
    for r in pairs.select("id", F.col("p.provider_id").alias("pid"), match.rule_score(f, p).alias("sc")).collect():
        want.setdefault(r.id, []).append((-r.sc, r.pid))
    got = {}
    for r in cs.top_providers(reqs, provs, k, fan=fan).collect():
        got.setdefault(r.id, []).append((r["rank"], -r.score, r.provider_id))
    assert {i: [(s, p) for _, s, p in sorted(v)] for i, v in got.items()} == {i: sorted(v)[:k] for i, v in want.items()}
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_listing_of_a_third_of_the_catalog(spark):
    """Copies of one listing are one leaf with k ids; the best ids win; repeated requests all get their rows; no id takes no part."""
    reqs, provs = tables(spark, 5, 20)
    same = provs.limit(1).drop("provider_id").crossJoin(spark.range(1000, 1500).select(F.col("id").alias("provider_id"))).select(*provs.columns)
    many = provs.unionByName(same).unionByName(same.limit(1).withColumn("provider_id", F.lit(None).cast("long")))
    assert cs.listings(many, 3).where(F.size("ids") > 3).count() == 0
    got = cs.top_providers(reqs.unionByName(reqs), many, 3, fan=4)
    pairs, f, p = full(reqs, many.where("provider_id IS NOT NULL"))
    want = sorted(r.sc for r in pairs.select("id", match.rule_score(f, p).alias("sc")).where("id = 0").collect())[::-1][:3]
    assert sorted(r.score for r in got.where("id = 0").collect()) == sorted(want * 2)


def test_empty_tables(spark):
    reqs, provs = tables(spark, 5, 5)
    assert cs.top_providers(reqs, provs.where("provider_id < 0")).count() == 0
    assert cs.top_providers(reqs.where("id < 0"), provs).count() == 0
    none = cs.feature_totals(reqs.where("id < 0"), provs).collect()
    assert len(none) == 5 and all(r.concernsOverlap is None and r.ageMatch == 0 for r in none)


def test_search_opens_few_listings(spark):
    """Twenty times the catalog, far less than twenty times the listings looked at."""
    def looked_at(n):
        reqs, provs = tables(spark, 40, n, 3)
        profiles = cs.at_root(reqs.withColumnRenamed("id", "profile"))
        levels = cs.block_levels(cs.listings(provs, 3), 8)
        return cs.candidates(cs.thresholds(profiles, levels, 3), levels).count() / 40

    small, large = looked_at(200), looked_at(4000)
    assert large < 0.1 * 4000 and large < 6 * small


def test_feature_totals_equal_all_pairs(spark):
    reqs, provs = tables(spark, 50, 30, 5)
    pairs, f, p = full(reqs, provs)
    yes = ["insuranceMatch", "insurancePartial", "ageMatch", "telehealthMatch", "languageMatch", "genderMatch"]
    shares = ["concernsOverlap", "modalityOverlap", "culturalOverlap"]
    rows = pairs.select(F.col("p.provider_id").alias("provider_id"), *match.pair_features(f, p))
    want = {r.provider_id: r for r in rows.groupBy("provider_id").agg(*[F.count_if(c).alias(c) for c in yes], *[F.avg(c).alias(c) for c in shares]).collect()}
    for r in cs.feature_totals(reqs, provs).collect():
        assert all(r[c] == pytest.approx(want[r.provider_id][c]) for c in yes + shares), (r, want[r.provider_id])

"""Request-to-provider matching: joins with the catalog, rule score, pair and model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BASE_FEATURES, PROVIDER_FLAGS
from ..functions import scalar as sc
from ..functions.skew import skewed_join

#: Providers that travel together in one row.
CHUNK = 1000


def with_provider(interactions: DataFrame, providers: DataFrame) -> DataFrame:
    """Interactions with provider flags, all false for an unknown provider.

    Adaptive execution broadcasts the catalog or splits a hot provider by what it measures.
    """
    joined = skewed_join(interactions, providers.select("provider_id", *PROVIDER_FLAGS), ["provider_id"], "left")
    return joined.select(*interactions.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in PROVIDER_FLAGS])


def profiles(requests: DataFrame, columns: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Distinct requests ``(profile, n, columns)`` and the profile of every request ``(key, profile)``.

    A score depends on what is asked only, so equal requests are scored once. A profile's number is a digest of its columns.
    """
    number = F.xxhash64(*[F.to_json(F.struct(c)) for c in columns])
    tagged = requests.withColumn("profile", number)
    return (tagged.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in columns]), tagged.select(key, "profile"))


def beside_providers(requests: DataFrame, providers: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every row of ``requests`` (profiles, as a rule) next to every provider of the catalog, as column ``p``.

    The catalog is packed into rows of about ``chunk`` providers; each request meets every such row once through a join on
    its number and unpacks it there.
    """
    chunks = max(1, -(-providers.count() // chunk))
    number = F.pmod(F.xxhash64(providers.columns[0]), F.lit(chunks)).cast("int")
    packed = providers.withColumn("_chunk", number).groupBy("_chunk").agg(F.collect_list(F.struct(*providers.columns)).alias("_list"))
    spread = requests.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return spread.join(packed, "_chunk").select(*requests.columns, F.explode("_list").alias("p"))


def rule_score(f: dict[str, Column], p: dict[str, Column]) -> Column:
    """Additive match score out of 100 (point budgets are fixed values)."""
    def offers(listing: str, item: str | Column) -> Column:
        return F.array_contains(p[listing], item)

    insurance = (F.when((f["insurance"] == "any") | offers("insurance", f["insurance"]), 26)
                 .when(offers("insurance", "sliding_scale") | offers("insurance", "uninsured"), 8).otherwise(0))
    age = F.when((f["ageGroup"] == "any") | offers("ages", f["ageGroup"]), 18).otherwise(0)
    tele = f["telehealth"]
    telehealth = (F.when(tele.isin("any", "in_person"), 11)
                  .when(tele.isin("required", "preferred") & p["telehealth"], 11)
                  .when(tele == "preferred", 4).otherwise(0))
    urgency = (F.when(f["urgency"].isin("routine", "exploring"), 9)
               .when((f["urgency"] == "crisis") & p["crisis"], 9)
               .when((f["urgency"] == "urgent") & p["crisis"], 7).otherwise(0))
    spoken = F.coalesce(p["languages"], F.array(F.lit("english")))
    language = F.when((f["language"] == "any") | F.array_contains(spoken, f["language"]), 4).otherwise(0)
    gender = F.when(f["providerGender"] == "any", 3).otherwise(0)

    def shared(name: str, budget: int, none_asked: int) -> Column:
        asked = _list(f[name])
        return F.when(F.size(asked) == 0, none_asked).otherwise(
            sc.points(budget, sc.overlap(asked, _list(p[name]), 0.0)))

    fixed = F.lit(5) + F.lit(1)  # session format and accessibility always count
    total = (insurance + age + shared("concerns", 17, 8) + telehealth + urgency + language + gender
             + shared("modalities", 4, 2) + shared("cultural", 2, 1) + fixed)
    return F.least(total, F.lit(100))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def pair_features(f: dict[str, Column], p: dict[str, Column]) -> list[Column]:
    """Nine match features of a request and a provider."""
    fallback = F.array_contains(p["insurance"], "sliding_scale") | F.array_contains(p["insurance"], "uninsured")
    accepted = F.array_contains(p["insurance"], f["insurance"])
    spoken = F.coalesce(p["languages"], F.array(F.lit("english")))
    tele = f["telehealth"]
    return [
        ((f["insurance"] == "any") | accepted).alias("insuranceMatch"),
        (~accepted & fallback).alias("insurancePartial"),
        ((f["ageGroup"] == "any") | F.array_contains(p["ages"], f["ageGroup"])).alias("ageMatch"),
        F.round(sc.overlap(_list(f["concerns"]), _list(p["concerns"]), 0.5), 3).alias("concernsOverlap"),
        (tele.isin("any", "in_person") | (tele.isin("required", "preferred") & p["telehealth"])).alias("telehealthMatch"),
        ((f["language"] == "any") | F.array_contains(spoken, f["language"])).alias("languageMatch"),
        (f["providerGender"] == "any").alias("genderMatch"),
        F.round(sc.overlap(_list(f["modalities"]), _list(p["modalities"]), 0.5), 3).alias("modalityOverlap"),
        F.round(sc.overlap(_list(f["cultural"]), _list(p["cultural"]), 0.0), 3).alias("culturalOverlap"),
    ]


def match_features(joined: DataFrame) -> DataFrame:
    """Twenty-two base features and eight products for interactions joined with providers."""
    crisis = F.col("urgency") == "crisis"
    source = {
        "insurance_match": sc.flag(F.col("insuranceMatch")), "insurance_partial": sc.flag(F.col("insurancePartial")),
        "age_match": sc.flag(F.col("ageMatch")), "concerns_overlap": F.col("concernsOverlap"),
        "telehealth_match": sc.flag(F.col("telehealthMatch")), "crisis_match": sc.flag(crisis & F.col("has_crisis")),
        "language_match": sc.flag(F.col("languageMatch")), "gender_match": sc.flag(F.col("genderMatch")),
        "modality_overlap": F.col("modalityOverlap"), "cultural_overlap": F.col("culturalOverlap"),
        "has_crisis_services": sc.flag(F.col("has_crisis")), "urgency_is_crisis": sc.flag(crisis),
        "urgency_is_urgent": sc.flag(F.col("urgency") == "urgent"),
        "user_uninsured": sc.flag(F.col("insurance").isin("uninsured", "sliding_scale")),
    }
    keep = [c for c in ("id", "group", "y", "p", "insurance_given", "age_group", "urgency_given", "insurance", "urgency") if c in joined.columns]
    base = joined.select(*[F.col(c) for c in keep if c not in BASE_FEATURES],
                         *[source.get(n, sc.flag(F.col(n)) if n in PROVIDER_FLAGS else None).alias(n) for n in BASE_FEATURES])
    return base.select("*", *sc.cross_features())


def labelled(interactions: DataFrame) -> DataFrame:
    """Engagement label per interaction."""
    return interactions.withColumn("y", sc.engagement(F.col("type"), F.col("rating")))

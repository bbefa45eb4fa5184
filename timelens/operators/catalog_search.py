"""Best providers of every request, and feature totals of every provider, without forming request-provider pairs.

Providers with the same listing score the same, so a catalog is first brought down to distinct listings with their smallest ids.
Listings lie in a tree of blocks. A block carries the union of what its providers offer, and since the rule score never falls
when a provider offers more, the score of that union bounds every provider inside. A request goes down the tree once by the best
bound, which yields a k-th best score; a second descent opens only blocks that could still beat it. The stop is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import first_n_per_key, in_order, skewed_join
from ..session import materialize
from .match import rule_score

#: Lists and flags of a listing, those with the most points first: neighbours in this order share them, so unions stay tight.
LISTS = ["insurance", "ages", "concerns", "languages", "modalities", "cultural"]
FLAGS = ["telehealth", "crisis"]
LISTING = ["ages", "insurance", "telehealth", "crisis", "concerns", "languages", "modalities", "cultural"]
ASKED = ["insurance", "ageGroup", "telehealth", "urgency", "language", "providerGender", "concerns", "modalities", "cultural"]
#: Children of a block, and paths that set a request's first threshold.
FAN, PATHS = 32, 8


def listings(providers: DataFrame, k: int) -> DataFrame:
    """Distinct listings with the ``k`` smallest ids of each; providers without an id take no part.

    At most ``k`` providers of a listing can be among anyone's best ``k``, so a listing shared by a third of the catalog is one
    row with ``k`` ids, pruned inside the map tasks.
    """
    def items(name: str) -> Column:
        missing = F.array(F.lit("english")) if name == "languages" else F.array().cast("array<string>")
        return F.array_sort(F.array_distinct(F.coalesce(F.col(name), missing))).alias(name)

    rows = providers.where("provider_id IS NOT NULL").select("provider_id", *[items(c) for c in LISTS], *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS])
    few = first_n_per_key(rows, LISTING, [F.col("provider_id")], k)
    return few.groupBy(*LISTING).agg(F.array_sort(F.collect_list("provider_id")).alias("ids"))


def block_levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels of the tree from the root down: one row a block, ``(s, a, kids)``; ``kids`` are at most ``fan`` blocks or listings.

    A node is named by its range partition and its place there, so no global number is needed; places are divided by ``fan``
    from level to level, then partitions are. Each level is written once and is ``fan`` times smaller than the one below.
    """
    placed = in_order(leaves, LISTING)
    span = placed.agg(F.max("_at").alias("a"), F.max("_slice").alias("s")).first()
    nodes = placed.select(F.col("_slice").cast("long").alias("s"), F.col("_at").cast("long").alias("a"), *LISTING, "ids",
                          F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("low"))
    levels, top_a, top_s = [], span["a"] or 0, span["s"] or 0
    while not levels or top_a or top_s:
        up_a, up_s = (F.floor(F.col("a") / fan), F.col("s")) if top_a else (F.col("a"), F.floor(F.col("s") / fan))
        top_a, top_s = (top_a // fan, top_s) if top_a else (top_a, top_s // fan)
        kids = materialize(nodes.select(up_s.cast("long").alias("s"), up_a.cast("long").alias("a"), F.struct(*nodes.columns).alias("kid"))
                           .groupBy("s", "a").agg(F.collect_list("kid").alias("kids")), "block_level")
        levels.append(kids)
        union = [F.array_distinct(F.flatten(F.col("kids")[c])).alias(c) if c in LISTS else F.exists(F.col("kids")[c], lambda x: x).alias(c) for c in LISTING]
        nodes = kids.select("s", "a", *union, F.aggregate(F.col("kids")["n"], F.lit(0).cast("long"), lambda t, x: t + x).alias("n"), F.array_min(F.col("kids")["low"]).alias("low"))
    return levels[::-1]


def _score(kid: Column) -> Column:
    return rule_score({c: F.col(c) for c in ASKED}, {c: kid[c] for c in LISTING}).cast("int")


def at_root(profiles: DataFrame) -> DataFrame:
    """``profiles`` with the address of the root, written once, so that every step, the first too, is an equality join."""
    return materialize(profiles.withColumn("s", F.lit(0).cast("long")).withColumn("a", F.lit(0).cast("long")), "request_profiles")


def thresholds(profiles: DataFrame, levels: list[DataFrame], k: int, key: str = "profile", paths: int = PATHS) -> DataFrame:
    """``profiles`` with ``t_score, t_id``: score and id of a k-th best provider found on the best-bound paths, null if they hold fewer.

    The ``paths`` best blocks under the root are each followed down by the best bound, those with ``k`` ids before others. A step is
    one join with a level; the next block is chosen inside the row.
    """
    keep = [c for c in profiles.columns if c not in ("s", "a")]
    at = profiles
    for depth, level in enumerate(levels[:-1]):
        ranked = F.array_sort(F.transform("kids", lambda x: F.struct((x["n"] < k).alias("few"), F.negative(_score(x)).alias("b"), x["low"].alias("l"),
                                                                     x["s"].alias("s"), x["a"].alias("a"))))
        best = F.explode(F.slice(ranked, 1, 1 if depth else paths))
        at = skewed_join(at, level, ["s", "a"]).select(*keep, best.alias("_best")).select(*keep, "_best.s", "_best.a")
    found = F.array_sort(F.flatten(F.transform("kids", lambda x: F.transform(x["ids"], lambda i: F.struct(F.negative(_score(x)).alias("m"), i.alias("i"))))))
    ends = skewed_join(at, levels[-1], ["s", "a"]).select(key, F.slice(found, 1, k).alias("_found"))
    kth = ends.groupBy(key).agg(F.try_element_at(F.array_sort(F.flatten(F.collect_list("_found"))), F.lit(k)).alias("_kth"))
    return profiles.join(kth, key).select(*profiles.columns, F.negative("_kth.m").alias("t_score"), F.col("_kth.i").alias("t_id"))


def candidates(profiles: DataFrame, levels: list[DataFrame], key: str = "profile") -> DataFrame:
    """``(key, score, ids)`` of every listing that a profile with ``t_score, t_id`` has to look at: its bound at every level
    is above the threshold, or equal with a smaller or the same id inside."""
    keep = [c for c in profiles.columns if c not in ("s", "a")]
    at = profiles
    for level in levels:
        opened = skewed_join(at, level, ["s", "a"]).select(*keep, F.explode("kids").alias("kid")).withColumn("score", _score(F.col("kid")))
        open_ = opened.where((F.col("t_score").isNull()) | (F.col("score") > F.col("t_score"))
                             | ((F.col("score") == F.col("t_score")) & (F.col("kid.low") <= F.col("t_id"))))
        at = open_.select(*keep, F.col("kid.s").alias("s"), F.col("kid.a").alias("a"))
    return open_.select(key, "score", F.col("kid.ids").alias("ids"))


def top_providers(requests: DataFrame, providers: DataFrame, k: int = 5, key: str = "id", fan: int = FAN) -> DataFrame:
    """``(key, rank, provider_id, score)``: the ``k`` best providers of every request by rule score, ties to the smaller id; all, if fewer.

    Equal requests are searched once. The result is that of scoring all pairs. Repeated requests give repeated results, a
    repeated provider row takes a place once a listing; no providers or no requests give no rows.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in ASKED])), 256)
    tagged = requests.select(key, *ASKED).withColumn("profile", digest)
    profiles = at_root(first_n_per_key(tagged.select("profile", *ASKED), ["profile"], [F.lit(1)], 1))
    levels = block_levels(listings(providers, k), fan)
    near = materialize(thresholds(profiles, levels, k), "thresholds")
    rows = candidates(near, levels).select("profile", "score", F.explode("ids").alias("provider_id"))
    best = first_n_per_key(rows, ["profile"], [F.desc("score"), F.col("provider_id")], k)
    packed = best.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct(F.negative("score").alias("m"), "provider_id"))).alias("best"))
    placed = skewed_join(tagged.select(key, "profile"), packed, ["profile"]).select(key, F.posexplode("best").alias("rank", "b"))
    return placed.select(key, (F.col("rank") + 1).cast("long").alias("rank"), "b.provider_id", F.negative("b.m").alias("score"))


def feature_totals(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Per provider: requests that meet each yes-or-no pair feature, and the mean of each overlap, over all requests.

    Every feature reads one criterion of a request, so requests are counted by criterion first. Yes-or-no features are sums over
    the provider's items in that inverted list; overlaps come from distinct asked sets that share an item with a distinct offered
    set. Nothing grows with requests times providers. Provider ids are unique; without requests the means are null.
    """
    single = {"insurance": "insurance", "ages": "ageGroup", "languages": "language", "gender": "providerGender", "tele": "telehealth"}
    asked = requests.select(F.explode(F.array(*[F.struct(F.lit(c).alias("crit"), F.col(q).alias("item")) for c, q in single.items()])).alias("x")).select("x.*")
    counts = materialize(asked.where("item IS NOT NULL").groupBy("crit", "item").agg(F.count(F.lit(1)).alias("n")), "criterion_counts")

    def have(crit: str, *items: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("crit") == crit) & F.col("item").isin(*items), F.col("n"))), F.lit(0))

    fixed = counts.agg(*[have(c, "any").alias(f"any_{c}") for c in ("insurance", "ages", "languages", "gender")], have("tele", "any", "in_person").alias("tele_free"),
                       have("tele", "required", "preferred").alias("tele_asked"),
                       F.coalesce(F.sum(F.when(F.col("crit") == "insurance", F.col("n"))), F.lit(0)).alias("insured")).first()
    spoken = F.coalesce(F.col("languages"), F.array(F.lit("english")))
    offers = {"insurance": F.col("insurance"), "ages": F.col("ages"), "languages": spoken}

    def posting(crit: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(offers[crit], F.array().cast("array<string>"))), lambda i: F.struct(F.lit(crit).alias("crit"), i.alias("item")))

    posted = providers.select("provider_id", F.explode(F.flatten(F.array(*[posting(c) for c in offers]))).alias("x")).select("provider_id", "x.*")
    met = skewed_join(posted, counts, ["crit", "item"]).groupBy("provider_id").agg(
        *[F.sum(F.when((F.col("crit") == c), F.col("n"))).alias(f"met_{c}") for c in offers],
        *[F.sum(F.when((F.col("crit") == c) & (F.col("item") != "any"), F.col("n"))).alias(f"named_{c}") for c in offers])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = providers.join(met, "provider_id", "left")
    fallback = F.coalesce(F.array_contains("insurance", "sliding_scale") | F.array_contains("insurance", "uninsured"), F.lit(False))
    yes = [(zero("named_insurance") + fixed["any_insurance"]).alias("insuranceMatch"),
           F.when(fallback, fixed["insured"] - zero("met_insurance")).otherwise(0).alias("insurancePartial"),
           (zero("named_ages") + fixed["any_ages"]).alias("ageMatch"),
           (fixed["tele_free"] + F.when(F.col("telehealth"), fixed["tele_asked"]).otherwise(0)).alias("telehealthMatch"),
           (zero("named_languages") + fixed["any_languages"]).alias("languageMatch"), F.lit(fixed["any_gender"]).alias("genderMatch")]
    empty = F.array().cast("array<string>")
    parts = []
    for name, col, when_empty in (("concernsOverlap", "concerns", 0.5), ("modalityOverlap", "modalities", 0.5), ("culturalOverlap", "cultural", 0.0)):
        canon = F.array_sort(F.array_distinct(F.coalesce(F.col(col), empty)))
        sets = materialize(requests.select(canon.alias("ask")).groupBy("ask").agg(F.count(F.lit(1)).alias("n")), "asked_sets")
        total = sets.agg(F.sum("n").alias("n"), F.sum(F.when(F.size("ask") == 0, F.col("n"))).alias("none")).first()
        given = providers.select(canon.alias("give")).distinct()
        both = (sets.select("ask", "n", F.explode("ask").alias("item")).join(given.select("give", F.explode("give").alias("item")), "item")
                .groupBy("give", "ask", "n").agg(F.count(F.lit(1)).alias("common")))
        share = F.round(F.col("common") / F.size("ask"), 3)
        sums = both.groupBy("give").agg(F.sum(share * F.col("n")).alias(f"_{name}"))
        start, n = when_empty * (total["none"] or 0), total["n"]
        out = skewed_join(out.withColumn("give", canon), sums, ["give"], "left").drop("give")
        parts.append(((F.coalesce(F.col(f"_{name}"), F.lit(0.0)) + start) / F.lit(n)).alias(name))
    return out.select("provider_id", *yes, *parts)

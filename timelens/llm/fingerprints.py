"""Document fingerprints by winnowing, in Spark SQL only.

A text's tokens are hashed, every run of ``k`` tokens gets a rolling hash (cyclic polynomial: the hash of a run is made
from those of its two halves by one rotation and one exclusive or), and of every ``w`` consecutive runs the one with the
smallest hash is kept, the rightmost of equal ones, with its place. Two texts that share ``w + k - 1`` tokens in a row
therefore share a kept hash. A run's hash (34 bits) and its place (30 bits) stand in one long, so that the smallest long of
a window is its winnowed run; window minima are found by doubling, in log2(w) passes. A string has less than 2^31 bytes and
a token with what divides it from the next one at least two, so 30 bits hold every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, table

#: A token is one character of a script without spaces, or up to 32 other characters without white space.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{1,32}"
PLACE_BITS = 30
PLACE = (1 << PLACE_BITS) - 1


def rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def with_neighbour(a: Column, distance: int, f) -> Column:
    """``f(a[i], a[i + distance])`` for every place that has both."""
    n = F.greatest(F.size(a) - distance, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 1 + distance, n), f)


def joined(bits: int):
    """Hash of a run from those of its halves, the second of ``bits`` tokens."""
    return lambda a, b: rotated(a, bits).bitwiseXOR(b)


def powers(n: int) -> list[int]:
    if n < 1 or n & (n - 1):
        raise ValueError("k and w are powers of two")
    return [1 << i for i in range(n.bit_length() - 1)]


def winnow(df: DataFrame, text_col: str, prefix: str, k: int = 4, w: int = 4) -> DataFrame:
    """``df`` with ``{prefix}kept`` (winnowed longs in text order) and ``{prefix}set`` (distinct kept hashes).

    Every pass is a column of its own, so that no pass is computed twice.
    """
    t, kept, distinct = f"{prefix}t", f"{prefix}kept", f"{prefix}set"
    col = F.col(t)
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    # A text shorter than one run counts as one run.
    df = df.withColumn(f"{prefix}whole", F.when((F.size(col) > 0) & (F.size(col) < k), F.array(F.xxhash64(col))))
    for d in powers(k):
        df = df.withColumn(t, with_neighbour(col, d, joined(d)))
    runs = F.coalesce(f"{prefix}whole", col)
    df = df.withColumn(t, F.transform(runs, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.lit(PLACE) - i.bitwiseAND(F.lit(PLACE)))))
    df = df.withColumn(f"{prefix}least", F.when(F.size(col) < w, F.array_compact(F.array(F.array_min(col)))))
    for d in powers(w):
        df = df.withColumn(t, with_neighbour(col, d, lambda a, b: F.least(a, b)))
    df = df.withColumn(kept, F.coalesce(F.col(f"{prefix}least"), F.array_distinct(col)))
    return df.withColumn(distinct, F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, PLACE_BITS)))).drop(t, f"{prefix}whole", f"{prefix}least")


def shown(kept: Column) -> Column:
    """``hash@place`` of every kept run, places from 0."""
    return F.array_join(F.transform(kept, lambda x: F.concat_ws("@", F.lower(F.hex(F.shiftrightunsigned(x, PLACE_BITS))),
                                                              (F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of hashes; two empty sets are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, w: int = 4) -> DataFrame:
    """``doc_id, kept array<struct<hash, place>>`` for every row; no shuffle.

    A null or empty text keeps nothing, a text of fewer than ``k`` tokens one run. Repeated rows give repeated results.
    """
    rows = winnow(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "f_", k, w)
    return rows.select("doc_id", F.transform("f_kept", lambda x: F.struct(F.shiftright(x, PLACE_BITS).alias("hash"), (
        F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE))).alias("place"))).alias("kept"))


def in_order(docs: DataFrame, segments: int = 256, bucket_rows: int = 512) -> DataFrame:
    """``docs (doc_id, text)`` with ``h`` (digest of the text) and ``b``, a bucket number that rises with (doc_id, h).

    Ids are cut at ``segments`` quantiles and then evenly inside each segment. Rows of an id that fills several segments,
    and rows without an id (which come first), are cut by their digest. So no bucket depends on a single id's row count.
    """
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                   F.percentile_approx("doc_id", [i / segments for i in range(1, segments)], 10_000).alias("cuts")).first()
    cuts = sorted(got["cuts"] or [])
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    lo, hi = [got["lo"] or 0, *cuts], [*cuts, got["hi"] or 0]
    parts, inner = max(1, -(-got["n"] // bucket_rows)), max(1, -(-got["n"] // (segments * bucket_rows)))
    x, h = F.col("doc_id"), F.xxhash64("text")
    arr = lambda v: F.array(*[F.lit(int(i)).cast("long") for i in v]) if v else F.array().cast("array<bigint>")
    by_hash = F.floor((h / F.lit(2.0 ** 64) + 0.5) * parts)
    seg = (F.size(F.filter(arr(cuts), lambda c: c <= x)) if cuts else F.lit(0)).cast("int")
    low, high = F.element_at(arr(lo), F.col("s") + 1).cast("double"), F.element_at(arr(hi), F.col("s") + 1).cast("double")
    even = F.least(F.lit(inner - 1), F.greatest(F.lit(0), F.floor((x.cast("double") - low) / (high - low + 1) * inner)))
    place = F.when(x.isNull(), by_hash - F.lit(1 << 40))
    if hot:
        place = place.when(x.isin(hot), by_hash)
    return (docs.withColumn("h", h).withColumn("s", F.when(x.isNull(), 0).otherwise(seg).cast("int"))
            .withColumn("b", F.coalesce(F.shiftleft(F.col("s").cast("long"), 40) + place.otherwise(F.lit(1 << 39) + even), F.lit(0)).cast("long")).drop("s"))


def with_next(ordered: DataFrame, k: int, w: int) -> DataFrame:
    """Adds the winnowed columns of ``text`` (prefix ``f_``) and ``next_text`` and ``next_set`` of the next row, the first after the last.

    The text is shuffled once, by bucket. Only bucket numbers are put in order across buckets.
    """
    dealt = ordered.repartition("b")
    own = Window.partitionBy("b").orderBy(F.asc_nulls_first("doc_id"), "h")
    rows = (winnow(dealt, "text", "f_", k, w).withColumn("rn", F.row_number().over(own))
            .withColumn("n_text", F.lead("text").over(own)).withColumn("n_set", F.lead("f_set").over(own)))
    firsts = dealt.withColumn("rn", F.row_number().over(own)).where("rn = 1").select("b", "text")
    numbers = ordered.select("b").distinct().withColumn("seg", F.shiftright("b", 40))
    follow = numbers.withColumn("nb", F.lead("b").over(Window.partitionBy("seg").orderBy("b")))
    order = Window.orderBy("seg")
    heads = (numbers.groupBy("seg").agg(F.min("b").alias("head"))
             .withColumn("nh", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    nexts = follow.join(heads, "seg").select("b", F.coalesce("nb", "nh").alias("nb"))
    links = winnow(nexts.join(firsts.withColumnRenamed("b", "nb"), "nb").select("b", F.col("text").alias("l_text")), "l_text", "l_", k, w)
    return (rows.join(links.select("b", "l_text", "l_set"), "b", "left")
            .withColumn("next_text", F.coalesce("n_text", "l_text")).withColumn("next_set", F.coalesce("n_set", "l_set")))


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, w: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last half is replaced by the head of the next text.

    Rows are ordered by id, rows without an id first, equal ids by a digest of the text; the last is followed by the first.
    A null text is empty. A single row is followed by itself. Repeated rows give repeated results, an empty table none.
    Other columns are dropped.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(in_order(base), k, w).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = winnow(rows.drop("next_text", "n_text", "l_text", "text"), "edited", "e_", k, w)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("f_kept")).alias("fingerprint"),
                       shown(F.col("e_kept")).alias("edited_fingerprint"), likeness(F.col("f_set"), F.col("e_set")).alias("near_edited"),
                       likeness(F.col("f_set"), F.col("next_set")).alias("near_next"))


@query("op8_winnowing_fingerprints")
def op8(spark, sf):
    """Fingerprints of all documents and of their edited texts."""
    return edit_test(table(spark, sf, "documents"))

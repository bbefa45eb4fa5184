"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound by multiplying its letters' vectors after rolling
each by its place, a text is the sum (bundle) of its trigrams' vectors, a language's prototype is the bundle of its training
texts, and a text gets the language whose prototype has the largest cosine. Bundling is linear, so a batch of texts is one
product of a trigram count matrix with the trigrams' vectors. Training sums whole numbers, so any split of the input gives
the same prototypes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, sizes, steps, table, text_list

SYMBOLS = 64
DIM = 1024
SEED = 7
#: Prototypes are sent to every task; a language column with more values than this is refused.
MAX_LANGS = 10_000
#: Bytes of text that are bundled at a time.
STEP = 1 << 20


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for other than letters, 1-26 for a-z in either case, hashed symbols for the rest."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or unicodedata.category(chr(cp))[0] != "L":
            continue
        low = ord(chr(cp).lower()[0])
        out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % 37
    return out


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    """Letter vectors rolled for each of the three places: shape (3, SYMBOLS, DIM)."""
    base = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1
    return np.stack([np.roll(base, 2, 1), np.roll(base, 1, 1), base])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and trigram code of every letter of a batch; words are bounded by symbol 0."""
    joined = "\0" + "\0".join(texts) + "\0"
    sym = symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.concatenate([[0], owner])
    mid = np.flatnonzero(sym[1:-1]) + 1
    return owner[mid], (sym[mid - 1] * SYMBOLS + sym[mid]) * SYMBOLS + sym[mid + 1]


def bundle(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Bundled vectors of ``n`` rows."""
    used = np.flatnonzero(np.bincount(codes, minlength=SYMBOLS ** 3))
    place = np.zeros(SYMBOLS ** 3, np.int64)
    place[used] = np.arange(len(used))
    counts = np.bincount(rows * len(used) + place[codes], minlength=n * len(used)).reshape(n, len(used))
    first, second, third = letter_vectors()
    vectors = first[used // SYMBOLS ** 2] * second[used // SYMBOLS % SYMBOLS] * third[used % SYMBOLS]
    kind = np.float32 if counts.max(initial=0) < 1 << 12 and counts.sum(1).max(initial=0) < 1 << 24 else np.float64
    return counts.astype(kind) @ vectors.astype(kind)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by five. A row without an id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_langs: int = MAX_LANGS) -> dict[str, np.ndarray]:
    """Prototype of every language among the rows with a text and a language.

    Each partition sends one vector a language; sums are merged by (language, dimension) before and after the shuffle.
    Rows with a null text or language take no part. No rows: no prototypes.
    """
    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b in steps(sizes(batch.column(0)), STEP):
                names, rows = np.unique(np.array(langs[a:b], dtype=object).astype(str), return_inverse=True)
                owner, codes = trigrams(text_list(batch.column(0).slice(a, b - a)))
                vec = bundle(rows[owner], codes, len(names)) if len(codes) else np.zeros((len(names), DIM))
                for name, v in zip(names.tolist(), vec):
                    total[name] = total.get(name, 0) + v.astype(np.int64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(sums, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    got = (summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
           .limit(max_langs + 1).collect())
    if len(got) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    return {r["lang"]: np.array(r["v"], dtype=np.float64) for r in sorted(got, key=lambda r: r["lang"])}


def classify(col: pa.Array, names: list[str], unit: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of a column."""
    langs, scores = ["und"] * len(col), np.zeros(len(col))
    for a, b in steps(sizes(col), STEP):
        owner, codes = trigrams(text_list(col.slice(a, b - a)))
        if not len(codes) or not len(names):
            continue
        vec = bundle(owner, codes, b - a)
        norm = np.sqrt((vec ** 2).sum(1, dtype=np.float64))
        cosine = (vec @ unit.T.astype(vec.dtype)) / np.maximum(norm, 1e-9)[:, None]
        best = cosine.argmax(1)
        for i in np.unique(owner).tolist():
            langs[a + i], scores[a + i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
    return langs, scores


def lettered(col: pa.Array) -> np.ndarray:
    """Whether each text of a column holds a letter."""
    out = np.zeros(len(col), bool)
    for a, b in steps(sizes(col), STEP):
        out[a + np.unique(trigrams(text_list(col.slice(a, b - a)))[0])] = True
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with ``lang_pred`` and ``score`` (cosine with the prototype, 0 to 1), one row for each row of ``docs``.

    ``und`` with score 0 if the text is null, holds no letter, or nothing was learned. Ties go to the first name in
    alphabetical order. Repeated rows give repeated results. Other columns are dropped. Whole texts are read.
    """
    names, unit = list(prototypes), np.array([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]).reshape(len(prototypes), DIM)

    def run(batches):
        for batch in batches:
            langs, scores = classify(batch.column(batch.num_columns - 1), names, unit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], schema=None,
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql import types as T
    picked = docs.select(*id_cols, F.col(text_col).alias("_text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """Rows of ``docs``, all columns whatever their names, whose text has a language with a cosine above ``min_score``; ``und`` goes.

    A text that is null or holds no letter is ``und`` always. Where nothing was learned no language can be told, so every text with a letter
    stays. Repeated rows stay or go together; an empty table gives no rows.
    """
    names, unit = list(prototypes), np.array([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]).reshape(len(prototypes), DIM)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if names:
                langs, scores = classify(batch.column(at), names, unit)
                stays = (np.array(langs) != "und") & (scores > min_score)
            else:
                stays = lettered(batch.column(at))
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)


@query("op6_language_profiles")
def op6(spark, sf):
    """Language of every document, learned from the documents whose id digest is not divisible by five."""
    docs = table(spark, sf, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, learn(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])

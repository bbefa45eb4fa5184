"""Batch text encoding with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize

# An encoder maker runs once per task and returns texts -> float matrix.
EncoderMaker = Callable[[], Callable[[list[str]], np.ndarray]]


def letter_encoder() -> Callable[[list[str]], np.ndarray]:
    """Letter counts a to z: a deterministic stand-in when no model is at hand."""
    def encode(texts: list[str]) -> np.ndarray:
        raw = (np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8) for t in texts)
        return np.array([np.bincount(b, minlength=256)[97:123] for b in raw], dtype=np.float64).reshape(-1, 26)
    return encode


def first_available(makers: list[EncoderMaker]) -> EncoderMaker:
    """Try the makers in order inside the task; the first that loads is used."""
    def make():
        last: Exception | None = None
        for m in makers:
            try:
                return m()
            except (ImportError, OSError) as err:
                last = err
        raise RuntimeError("no encoder could be loaded") from last
    return make


def id_filter(ids: DataFrame, bits_each: int = 16, most_bits: int = 1 << 28) -> np.ndarray:
    """Bloom filter of ``ids``: a power of two of 64-bit words, at most ``most_bits``. What it misses is not among them."""
    log = int(min(most_bits, max(1 << 10, bits_each * ids.count()))).bit_length() - 1
    spots_of = filter_spots(log)

    def words(batches):
        for batch in batches:
            spots = np.unique(np.concatenate(spots_of(batch.column(0).to_numpy())))
            word, first = np.unique(spots >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (spots & 63).astype(np.uint64), first) if len(spots) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = ids.select(F.xxhash64("id").alias("h")).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << log - 6, np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.view(np.uint64)


def filter_spots(log: int):
    """Function: 64-bit hashes -> four bits of a filter of ``1 << log`` for each; it travels with the tasks."""
    def spots(h):
        h = h.view(np.uint64)
        step = (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        return [((h + np.uint64(k) * step) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - log)).astype(np.int64) for k in range(4)]
    return spots


def maybe_among(log: int):
    """Function (filter, hashes) -> which of them may be among its ids."""
    spots = filter_spots(log)

    def run(words, h):
        return np.logical_and.reduce([words[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1) > 0 for s in spots(h)])
    return run


def encode_posts(posts: DataFrame, maker: EncoderMaker = letter_encoder, batch: int = 32, normalise: bool = True, known=None) -> DataFrame:
    """``(id, embedding)`` of posts with text. Filter known ids before calling.

    ``known``, a broadcast ``(filter of ids, ids)``, leaves out posts that the filter may hold unless they are among the ids.
    """
    texts = posts.select("id", tx.compose("title", "body", trim=True).alias("text"), F.xxhash64("id").alias("h")).filter(F.length("text") > 0)
    if known is None:
        texts = texts.drop("h")
    may = maybe_among(len(known.value[0]).bit_length() + 5) if known else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = maker()
        for pdf in frames:
            if known:
                words, ids = known.value
                pdf = pdf[~may(words, pdf["h"].to_numpy()) | pdf["id"].isna() | pdf["id"].isin(ids)]
            blocks = [encode(pdf["text"].iloc[i:i + batch].tolist()) for i in range(0, len(pdf), batch)]
            if not blocks:
                continue
            vecs = np.vstack(blocks)
            if normalise:
                vecs = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "embedding": list(vecs.astype(np.float32))})

    return texts.mapInPandas(run, "id string, embedding array<float>")


def encode_missing(posts: DataFrame, cached: DataFrame, maker: EncoderMaker = letter_encoder, most_ids: int = 1 << 20, bits_each: int = 16, **kw) -> DataFrame:
    """Cached vectors plus vectors of the posts that have none.

    No text is shuffled to find them: posts that a filter of the cached ids misses have no vector, and of the others ids alone meet the cached
    ones. The few that the filter takes for cached ones (up to ``most_ids``) are sent to the tasks.
    """
    ids, spark = cached.select("id"), posts.sparkSession
    words = id_filter(ids, bits_each)
    sent, may = spark.sparkContext.broadcast(words), maybe_among(len(words).bit_length() + 5)

    def maybe(batches):
        for b in batches:
            yield b.select([0]).filter(pa.array(may(sent.value, b.column(1).to_numpy())))

    like = posts.filter("id is not null").select("id").select("id", F.xxhash64("id").alias("h")).mapInArrow(maybe, f"id {posts.schema['id'].dataType.simpleString()}")
    wrong = materialize(like.join(ids, "id", "left_anti").distinct(), "filtered_ids")
    if wrong.count() > most_ids:
        fresh = encode_posts(posts.join(ids, "id", "left_anti"), maker, **kw)
    else:
        fresh = encode_posts(posts, maker, known=spark.sparkContext.broadcast((words, [r["id"] for r in wrong.collect()])), **kw)
    return cached.select("id", "embedding").unionByName(fresh)

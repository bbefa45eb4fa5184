"""Exact deduplication by composable polynomial fingerprints.

The bytes of a normalised text are the digits of a number in base 256; its residue modulo a 127-bit prime is the
fingerprint. Residues of chunks combine by length-shifted arithmetic, ``H(ab) = H(a) * 256^len(b) + H(b)``, so that the
chunks of a huge document are hashed by different tasks. Rows of one length and fingerprint are compared chunk by chunk in a
sorted stream; where texts differ all the same, they are split by comparing them with one text of the group at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_list, query, sizes, steps, table

#: The first prime from the first 127 bits of SHA-256 of "exact dedup" on (highest and lowest bit set).
MODULUS = 0x54952CD0AB25662A28994695B8C601C7
CHUNK_BYTES = 1 << 20
#: Bytes of text that one task keeps in order to send each text once.
HELD_BYTES = 32 << 20
#: A fingerprint (or class) with more than one of these shares of all rows is hot; there are at most as many hot ones.
SHARES = 1024
KEY = ["n_bytes", "hi", "lo"]


def normalise(raw: bytes) -> bytes:
    """Every run of blanks ``[\\x20\\x09-\\x0D]`` as one space."""
    words = b" ".join(raw.split())
    if not raw:
        return raw
    if not words:
        return b" "
    return (b" " if raw[:1].isspace() else b"") + words + (b" " if raw[-1:].isspace() else b"")


def fingerprint(chunk: bytes, modulus: int = MODULUS) -> int:
    return int.from_bytes(chunk, "big") % modulus


def combine(parts: list[tuple[int, int]], modulus: int = MODULUS) -> int:
    """Fingerprint of a text from the (length, fingerprint) of its chunks in order."""
    h = 0
    for n, x in parts:
        h = (h * pow(256, n, modulus) + x) % modulus
    return h


def halves(h: int) -> tuple[int, int]:
    """A fingerprint as two signed 64-bit numbers."""
    return h >> 64, (h & (1 << 64) - 1) - (1 << 63)


def whole(hi: int, lo: int) -> int:
    return hi << 64 | lo + (1 << 63)


def _scan(docs: DataFrame, chunk: int, held: int, modulus: int) -> DataFrame:
    """One row a document (``piece`` 0), more for the further chunks of long ones.

    ``rid`` numbers the rows, ``rep`` is the row of the same task whose equal text is sent for it; only such rows carry
    ``chunk``. Texts of one chunk get their fingerprint here, longer ones none yet.
    """
    def run(batches):
        part, n = TaskContext.get().partitionId() << 36, 0
        seen: dict[tuple, list] = {}
        room = held
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1)
            for a, b in steps(sizes(raw)):
                out = [[] for _ in range(9)]
                for doc, text in zip(ids[a:b].to_pylist(), byte_list(raw[a:b])):
                    text, rid = normalise(text), part | n
                    n += 1
                    size, sha = len(text), hashlib.sha256(text).hexdigest()
                    if size > chunk:
                        for p, at in enumerate(range(0, size, chunk)):
                            for col, x in zip(out, (rid, doc, size, None, None, sha, rid, p, text[at:at + chunk])):
                                col.append(x)
                        continue
                    h = fingerprint(text, modulus)
                    same = seen.setdefault((size, h), [])
                    rep = next((r for r, t in same if t == text), None)
                    if rep is None:
                        room -= size + 200
                        if room < 0:
                            seen, room = {}, held - size - 200
                            same = seen.setdefault((size, h), [])
                        same.append((rid, text))
                    for col, x in zip(out, (rid, doc, size, *halves(h), sha, rid if rep is None else rep, 0, text if rep is None else None)):
                        col.append(x)
                i = pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (i, i, i, i, i, pa.string(), i, pa.int32(), pa.binary()))],
                                                 names=["rid", "doc_id", "n_bytes", "hi", "lo", "sha", "rep", "piece", "chunk"])

    return docs.mapInArrow(run, "rid long, doc_id long, n_bytes long, hi long, lo long, sha string, rep long, piece int, chunk binary")


def _long_prints(long: DataFrame, modulus: int) -> DataFrame:
    """``rid, hi, lo`` of texts of several chunks: chunks are dealt over all tasks, hashed there, and combined by text."""
    def hashed(batches):
        for batch in batches:
            hi, lo = zip(*[halves(fingerprint(x, modulus)) for x in batch.column(2).to_pylist()]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes(batch.column(2)), pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["rid", "piece", "n", "hi", "lo"])

    def joined(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["piece"])
        hi, lo = halves(combine([(r["n"], whole(r["hi"], r["lo"])) for r in rows], modulus))
        return pa.table({"rid": pa.array([rows[0]["rid"]], pa.int64()), "hi": pa.array([hi], pa.int64()), "lo": pa.array([lo], pa.int64())})

    parts = long.select("rid", "piece", "chunk").repartition("rid", "piece").mapInArrow(hashed, "rid long, piece int, n long, hi long, lo long")
    return parts.groupBy("rid").applyInArrow(joined, "rid long, hi long, lo long")


def _differing(texts: DataFrame, by: list[str]) -> DataFrame:
    """Fingerprints under which some chunk is not equal to the one before it in its sorted stream."""
    before = Window.partitionBy(*by, "piece").orderBy("rid")
    return (texts.select(*by, "piece", "rid", "chunk", F.lag("chunk").over(before).alias("last"))
            .where("last IS NOT NULL AND chunk <> last").select(*KEY))


def _split(texts: DataFrame) -> DataFrame | None:
    """``rep, variant`` of texts that share a fingerprint with a different text: 0 equals the group's first text, and so on.

    Each round compares what is left with the first text of its group and keeps what differs from it, so there are as many
    rounds as a fingerprint has different texts.
    """
    found, left = [], materialize(texts, "dedup_mixed")
    while True:
        heads = left.groupBy(*KEY).agg(F.min("rid").alias("rid"))
        first = left.join(heads, [*KEY, "rid"]).select(*KEY, "piece", F.col("chunk").alias("want"))
        differ = materialize(left.join(first, [*KEY, "piece"]).where("chunk <> want").select("rid").distinct(), "dedup_differ")
        if differ.isEmpty():
            break
        found.append(differ)
        left = materialize(left.join(differ, "rid", "left_semi"), "dedup_left")
    if not found:
        return None
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy(F.col("rid").alias("rep")).agg(F.count(F.lit(1)).alias("variant"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, held_bytes: int = HELD_BYTES,
          modulus: int = MODULUS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``.

    Texts are equal when they are identical after each run of blanks became one space; a null text is empty. Of equal texts
    the row with the smallest id stays: ids are taken before no id, and of rows that tie one stays. ``keep_id`` is the id of that
    row (null if no row of the group has one), ``group_size`` the rows of the group. An empty table gives no rows. Other columns
    are dropped, whatever their names. ``n_bytes`` and ``text_sha256`` are those of the normalised text.

    Equal texts of one task are sent on once (within ``held_bytes``). A fingerprint with more than 1/1024 of all rows is compared
    in slices, and the first texts of the slices among themselves, so that no task gets it whole. The modulus decides how
    often different texts must be told apart by comparison, never the result.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialize(_scan(chosen, chunk_bytes, held_bytes, modulus), "dedup_scan")
    is_long = F.col("n_bytes") > chunk_bytes
    prints = materialize(_long_prints(made.where(is_long), modulus), "dedup_long")
    short, long = made.where(~is_long), made.where(is_long).drop("hi", "lo").join(prints, "rid")
    rows = short.unionByName(long).where("piece = 0").select("rid", "doc_id", *KEY, "sha", "rep")
    texts = short.unionByName(long).where("chunk IS NOT NULL").select("rid", *KEY, "piece", "chunk")

    # Hot fingerprints: at most SHARES of them, so the list may be broadcast; their texts are compared in slices.
    senders = rows.where("rid = rep")
    total = senders.count()
    limit = max(1, total // SHARES)
    hot = senders.groupBy(*KEY).count().where(F.col("count") > limit).select(*KEY, F.ceil(F.col("count") / limit).alias("slices"))
    dealt = (texts.join(F.broadcast(hot), KEY, "left")
             .withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.col("slices")))))
    heads = (senders.join(F.broadcast(hot), KEY).withColumn("slice", F.pmod(F.xxhash64("rid"), F.col("slices")))
             .groupBy(*KEY, "slice").agg(F.min("rid").alias("rid")).select("rid"))
    first_texts = texts.join(F.broadcast(heads), "rid", "left_semi")
    mixed = materialize(_differing(dealt, [*KEY, "slice"]).unionByName(_differing(first_texts, KEY)).distinct(), "dedup_differing")

    variants = None if mixed.isEmpty() else _split(texts.join(mixed, KEY, "left_semi"))
    if variants is None:
        rows = rows.withColumn("variant", F.lit(0).cast("long"))
    else:
        rows = rows.join(variants, "rep", "left").withColumn("variant", F.coalesce("variant", F.lit(0).cast("long")))
    return _answer(rows)


def _answer(rows: DataFrame) -> DataFrame:
    """The class of every row; classes with a large share of the rows are few and go to the rows by broadcast."""
    rows = materialize(rows.drop("rep"), "dedup_rows")
    key = [*KEY, "variant"]
    classes = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"),
                                                 F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head")), "dedup_classes")
    large = classes.where(F.col("group_size") > max(1, rows.count() // SHARES))
    rest = classes.join(F.broadcast(large.select(*key)), key, "left_anti")
    both = rows.join(F.broadcast(large), key).unionByName(rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(rest, key))
    return both.select("doc_id", F.col("head.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("head.rid")).alias("kept"),
                       F.col("sha").alias("text_sha256"), "n_bytes")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256, strlen(t) AS n_bytes FROM t
"""


@query("op13_exact_dedup", SQL)
def op13(spark, sf):
    """Every document with the one of its equals that stays."""
    return group(table(spark, sf, "documents"))

"""Removal of byte strings that occur more than once, by two-stage suffix sorting.

*Dealing.* All windows of ``length`` bytes that are equal must meet in one place. Each window gets the smallest hash of its
``K``-byte runs; neighbouring windows with the same one form a segment. Equal windows have the same smallest hash, so only
segments whose hash occurs again can hold a repeat. Equal segments are counted, not repeated: all their windows are
repeats, and one of them stands for all from there on.

*Sorting.* Segments that share a hash come to one task and are put in suffix order in blocks. Suffixes smaller than their
successors (and ends) are sorted directly; all others are induced: the sorted suffixes are scanned bucket by bucket, and
whatever precedes one of them is put at the front of its own bucket in that order. Neighbours in suffix order whose common
prefix reaches ``length`` are repeats.

*Hot hashes.* A hash with more than ``hot_rows`` different segments would make one task too large. Its segments are cut
into single windows, which Spark groups by a 128-bit digest; every window is still compared with every other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_list, mix64, query, steps, table

K = 48
#: Windows of a segment at most, so that a long periodic text makes many bounded segments.
SEGMENT = 1024
#: Windows that one suffix array holds.
BLOCK = 300_000
_rng = np.random.default_rng(3)
BYTES = _rng.integers(0, 2 ** 64, (2, 256), dtype=np.uint64)


def rolled(a: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Cyclic-polynomial hash of every run of ``sum(sizes)`` bytes; sizes are falling powers of two."""
    def turn(x, bits):
        bits %= 64
        return x if not bits else (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    level, have = a, {1: a}
    d = 1
    while d < sizes[0]:
        level = mix_step(turn(level[:-d], d) ^ level[d:]) if d >= 32 else turn(level[:-d], d) ^ level[d:]
        d *= 2
        have[d] = level
    n, out, at = len(a) - sum(sizes) + 1, None, 0
    for s in sizes:
        part = have[s][at:at + n]
        out = part if out is None else turn(out, 23) * np.uint64(0x9E3779B97F4A7C15) ^ part
        at += s
    return out


def mix_step(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def binary_parts(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def segments(texts: list[bytes], length: int):
    """``(text number, start, windows, hash, digest, times)`` of every segment; ``times`` is how often the hash stands in it, 2 at most."""
    own = [i for i, t in enumerate(texts) if len(t) >= length]
    if not own:
        return
    raw = b"".join(texts[i] for i in own)
    sizes = np.array([len(texts[i]) for i in own])
    base = np.concatenate([[0], np.cumsum(sizes)])
    h = mix64(rolled(BYTES[0][np.frombuffer(raw, np.uint8)], binary_parts(K)))
    least, span = h, length - K + 1
    d = 1
    while d * 2 <= span:
        least = np.minimum(least[:-d], least[d:])
        d *= 2
    if span > d:
        least = np.minimum(least[:len(least) - (span - d)], least[span - d:])
    for i, a, b in zip(own, base.tolist(), base[1:].tolist()):
        m = least[a:b - length + 1]
        cut = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
        if (np.diff(cut) > SEGMENT).any():
            cut = np.unique(np.concatenate([cut, *(np.arange(x, y, SEGMENT) for x, y in zip(cut[:-1], cut[1:]) if y - x > SEGMENT)]))
        value = m[cut[:-1]]
        for s, e, v, v64 in zip(cut.tolist(), cut[1:].tolist(), value.view(np.int64).tolist(), value):
            times = int(np.count_nonzero(h[a + s:a + e + span - 1] == v64))
            yield i, s, e - s, v, xxhash.xxh3_64_intdigest(raw[a + s:a + e + length - 1]) - (1 << 63), min(times, 2)


def suffix_order(text: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Places of ``text`` in suffix order, by their first ``length`` bytes.

    Parts of the text are ``[start, end)``, each followed by one byte that stands for the end of the part and is smaller
    than all others; the first ``wanted`` places of each part are to be ordered.
    """
    n = len(text)
    rise = np.zeros(n, np.int16)
    rise[:-1] = text[1:].astype(np.int16) - text[:-1]
    rise[end - 1], rise[end] = -1, 1
    change = np.where(rise != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(change[::-1])[::-1]
    smaller = rise[np.minimum(nearest, n - 1)] > 0
    # Beyond the wanted places of a part, as far as the first place that is sorted directly.
    stop = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1][start + wanted - 1]
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, np.minimum(stop, end) + 1, -1)
    inside = np.cumsum(mark[:n]) > 0
    is_end = np.zeros(n, bool)
    is_end[end] = True
    direct = np.flatnonzero(inside & smaller & ~is_end)
    limit = np.minimum(direct + length, end[np.searchsorted(end, direct)])
    by_text = sorted(zip(direct.tolist(), limit.tolist()), key=lambda p: raw[p[0]:p[1]])
    direct = np.fromiter((p for p, _ in by_text), np.int64, len(by_text))
    first = text[direct]
    edge = np.searchsorted(first, np.arange(257))
    induced = inside & ~smaller & ~is_end
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def scan(places, above):
        """Deal the places before ``places`` to their buckets; those of the same bucket are returned."""
        before = places[places > 0] - 1
        before = before[induced[before]]
        own = text[before]
        same = before[own == above] if above >= 0 else before[:0]
        before, own = (before[own > above], own[own > above]) if above >= 0 else (before, own)
        order = np.argsort(own, kind="stable")
        before, own = before[order], own[order]
        cut = np.flatnonzero(np.diff(own)) + 1
        for part in np.split(before, cut) if len(before) else []:
            waiting[text[part[0]]].append(part)
        return same

    scan(np.flatnonzero(is_end & inside), -1)
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, c)
        mine = direct[edge[c]:edge[c + 1]]
        if len(mine):
            out.append(mine)
            scan(mine, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part a flag for every window: another window of these parts holds the same bytes."""
    raw = b"\0".join(parts) + b"\0" * 8
    text = np.frombuffer(raw, np.uint8)[:len(raw) - 7]
    sizes = np.array([len(p) for p in parts])
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    end, wanted = start + sizes, sizes - length + 1
    order = suffix_order(text, raw, start, end, wanted, length)
    part = np.searchsorted(end, order)
    order = order[order - start[part] < wanted[part]]
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    # Common prefixes of neighbours: pairs stay while they agree, eight bytes at a time.
    left = np.arange(max(0, len(order) - 1))
    places = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    if length < 8:
        words, places = text, range(length)
    for at in places:
        left = left[words[order[left] + at] == words[order[left + 1] + at]]
    flag = np.zeros(len(raw), bool)
    flag[order[left]] = flag[order[left + 1]] = True
    return [flag[s:s + w] for s, w in zip(start.tolist(), wanted.tolist())]


def runs_of(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeats(docs: DataFrame, length: int, hot_rows: int) -> DataFrame:
    """``id, th, spans array<struct<s, e>>``: the windows ``[s, e)`` of each text that stand elsewhere too.

    ``docs`` has ``id`` (not null), ``th`` (a digest of the text, for rows that share an id) and ``text`` (not null).
    """
    def cut(batches):
        for batch in batches:
            texts = byte_list(batch.column(2))
            for a, b in steps([len(t) for t in texts], 1 << 20):
                got = list(zip(*segments(texts[a:b], length)))
                if got:
                    at = pa.array(np.array(got[0]) + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(v, t) for v, t in zip(
                        got[1:], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]))], names=["id", "th", "start", "n", "mh", "sh", "times"])

    cuts = materialize(docs.mapInArrow(cut, "id long, th long, start int, n int, mh long, sh long, times int"), "sfx_segments")
    again = (cuts.groupBy("mh").agg(F.sum("times").alias("all"), F.min("sh").alias("lo"), F.max("sh").alias("hi"), F.max("times").alias("most"))
             .where("all > 1").select("mh", F.expr("lo <> hi OR most > 1").alias("mixed")))
    found = materialize(cuts.select("id", "th", "start", "n", "mh", "sh").join(again, "mh"), "sfx_again")
    kinds = (found.groupBy("mh", "sh").agg(F.count(F.lit(1)).alias("copies"), F.max("mixed").alias("mixed"),
                                           F.min(F.struct("id", "th", "start", "n")).alias("rep")))
    kinds = materialize(kinds, "sfx_kinds")
    equal = (found.join(kinds.where("copies > 1").select("mh", "sh"), ["mh", "sh"])
             .select("id", "th", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")))
    mixed = kinds.where("mixed").select("mh", "copies", "rep.*")
    hot = mixed.groupBy("mh").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_rows).select("mh", F.lit(True).alias("hot"))
    places = (mixed.join(hot, "mh", "left").groupBy("id", "th")
              .agg(F.collect_list(F.struct("mh", F.coalesce("hot", F.lit(False)).alias("hot"), "copies", "start", "n")).alias("cuts")))

    def take(batches):
        for batch in batches:
            ids, ths, texts = batch.column(0), batch.column(1), byte_list(batch.column(2))
            for i, (text, lists) in enumerate(zip(texts, batch.column(3))):
                got = lists.values
                if not len(got):
                    continue
                start, n = got.field("start").to_pylist(), got.field("n").to_pylist()
                at = pa.array([i] * len(got))
                yield pa.RecordBatch.from_arrays([ids.take(at), ths.take(at), got.field("mh"), got.field("hot"), got.field("copies"), got.field("start"),
                                                  pa.array([text[s:s + k + length - 1] for s, k in zip(start, n)], pa.binary())],
                                                 names=["id", "th", "mh", "hot", "copies", "start", "seg"])

    segs = docs.join(places, ["id", "th"]).select("id", "th", "text", "cuts").dropDuplicates(["id", "th"]).mapInArrow(
        take, "id long, th long, mh long, hot boolean, copies long, start int, seg binary")
    segs = materialize(segs, "sfx_bytes")

    def sort_block(rows):
        out = []
        for (i, th, start, copies, _), flag in zip(rows, repeated([r[4] for r in rows], length)):
            if copies == 1:
                out += [(i, th, start + a, start + b) for a, b in runs_of(flag)]
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["id", "th", "s", "e"])

    def sort(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for i, th, mh, copies, start, seg in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and mh != last:
                    yield sort_block(rows)
                    rows, size = [], 0
                rows.append((i, th, start, copies, seg))
                size, last = size + len(seg) - length + 1, mh
        if rows:
            yield sort_block(rows)

    sorted_ = (segs.where("NOT hot").select("id", "th", "mh", "copies", "start", "seg").repartition("mh").sortWithinPartitions("mh")
               .mapInArrow(sort, "id long, th long, s int, e int"))

    def windows(batches):
        for batch in batches:
            for i, th, copies, start, seg in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.frombuffer(seg, np.uint8)
                d1, d2 = (rolled(BYTES[j][a], binary_parts(length)).view(np.int64) for j in (0, 1))
                k = len(d1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i)), pa.array(np.full(k, th)), pa.array(np.full(k, copies)),
                                                  pa.array(np.arange(start, start + k, dtype=np.int32)), pa.array(d1), pa.array(d2)],
                                                 names=["id", "th", "copies", "s", "d1", "d2"])

    single = segs.where("hot").select("id", "th", "copies", "start", "seg").mapInArrow(
        windows, "id long, th long, copies long, s int, d1 long, d2 long")
    often = single.groupBy("d1", "d2").agg(F.sum("copies").alias("c")).where("c > 1").select("d1", "d2")
    hot_spans = single.where("copies = 1").join(often, ["d1", "d2"]).select("id", "th", "s", (F.col("s") + 1).alias("e"))
    spans = equal.unionByName(sorted_).unionByName(hot_spans)
    return spans.groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the windows cover, joined where they touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        e += length - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, hot_rows: int) -> DataFrame:
    """All columns of ``docs`` and ``_text`` (null: empty) and ``_spans`` (null: none).

    Texts that share an id are told apart by a 64-bit digest. Rows without an id have a second one in its place, 128 bits in all.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(1), text)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    source = keyed.select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_text").alias("text"))
    found = repeats(source, length, hot_rows).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    return keyed.join(found, ["_id", "_th"], "left")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot_rows: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the removed byte ranges of the text in UTF-8. A byte goes if a string of ``length`` bytes that starts
    anywhere else too, in this text or another, covers it. A null text is empty; texts shorter than ``length`` lose
    nothing. Repeated rows are copies of each other and lose all that is long enough. An empty table gives no rows. Other
    columns are dropped; names that begin with ``_`` are reserved.
    """
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", length, hot_rows)

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(byte_list(batch.column(1)), batch.column(2).to_pylist()):
                gone = merged([(x["s"], x["e"]) for x in spans or []], length)
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_text", "_spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot_rows: int = 4096) -> DataFrame:
    """``docs``, all rows and columns, without the repeated bytes of ``text_col``; characters cut in two go as a whole."""
    rows = with_spans(docs, id_col, text_col, length, hot_rows).select(*docs.columns, "_text", "_spans")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for old, text, spans in zip(batch.column(at).to_pylist(), byte_list(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    parts, last = [], 0
                    for a, b in merged([(x["s"], x["e"]) for x in spans], length):
                        parts.append(text[last:a])
                        last = b
                    old = "".join(p.decode("utf-8", "ignore") for p in [*parts, text[last:]])
                out.append(old)
            cols = batch.columns[:-2]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-2])

    return rows.mapInArrow(run, docs.schema)


@query("op3_suffix_array_dedup")
def op3(spark, sf):
    """Every document without the strings of 200 bytes that stand elsewhere too."""
    return find(table(spark, sf, "documents"))

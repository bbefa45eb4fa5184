"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens. A minimal perfect hash over the vocabulary resolves those that are tokens as a whole. The
others are merged: their bytes form a linked list, a heap holds the adjacent pairs by rank and place, and the best pair is
taken until none is left. Inside a task equal pre-tokens are resolved once for each batch, and a table of bounded size
keeps results between batches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, steps, table, text_list

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters only can take the plain pattern below; any other text takes the tokenizer's own.
PLAIN = re.compile(rf"[^\x00-\x1b\x20-\x7e{LETTERS}]")
#: Fixed value: the pattern that the plain one stands for on such texts.
FULL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r {LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
MASK = (1 << 64) - 1
#: Pre-tokens kept between batches by one worker.
KEPT = 300_000


class PerfectHash:
    """Minimal perfect hash by displacement: ``get(key)`` is the key's number or None, from two array reads and one compare.

    Keys are put in buckets by one half of their digest. From the largest bucket on, each gets the first displacement
    that sends all its keys to free slots; a bucket of one key gets its slot directly (stored as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        digests = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(digests):
            groups.setdefault(h % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        self.number, self.key = [-1] * n, [b""] * n
        free = np.ones(n, bool)
        order = sorted(groups, key=lambda b: (-len(groups[b]), b))
        for b in order:
            mine = groups[b]
            if len(mine) == 1:
                break
            h, first = np.array([digests[i] for i in mine], np.uint64), 1
            while True:
                slots = self._slots(h, np.arange(first, first + 64, dtype=np.uint64))
                fits = free[slots].all(1)
                sorted_slots = np.sort(slots, 1)
                fits &= (sorted_slots[:, 1:] != sorted_slots[:, :-1]).all(1)
                if fits.any():
                    at = int(fits.argmax())
                    break
                first += 64
            self.shift[b] = first + at
            for i, s in zip(mine, slots[at].tolist()):
                free[s], self.number[s], self.key[s] = False, i, keys[i]
        rest = iter(np.flatnonzero(free).tolist())
        for b in order:
            if len(groups[b]) == 1:
                s = next(rest)
                self.shift[b], i = -s - 1, groups[b][0]
                self.number[s], self.key[s] = i, keys[i]

    def _slots(self, h, d):
        x = h[None, :] ^ (d[:, None] * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes):
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d > 0:
            x = h ^ (d * 0x9E3779B97F4A7C15 & MASK)
            s = (((x ^ (x >> 31)) * 0xD6E8FEB86659FD93 & MASK) >> 32) % self.n
        elif d < 0:
            s = -d - 1
        else:
            return None
        return self.number[s] if self.key[s] == key else None


class Bpe:
    def __init__(self, tokens: tuple[bytes, ...], pattern: str):
        """``tokens`` in rank order; every single byte is among them."""
        self.tokens = tokens
        self.whole = PerfectHash(list(tokens))
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = [rank[bytes([b])] for b in range(256)]
        #: (left token, right token) -> token, for every cut of every token into two tokens.
        self.pair = {rank[t[:c]] << 32 | rank[t[c:]]: r for t, r in rank.items() for c in range(1, len(t)) if t[:c] in rank and t[c:] in rank}
        self.full = regex.compile(pattern)
        self.plain = re.compile(PLAIN_PATTERN) if pattern == FULL_PATTERN else self.full
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of a pre-token: always the pair with the lowest rank, the leftmost of equal ones."""
        ids = [self.byte[b] for b in piece]
        n, pair = len(ids), self.pair.get
        here = [pair(ids[i] << 32 | ids[i + 1], -1) for i in range(n - 1)]
        heap = [r << 32 | i for i, r in enumerate(here) if r >= 0]
        if not heap:
            return ids
        here.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if here[i] != r:
                continue
            gone = after[i]
            nxt = after[i] = after[gone]
            ids[i], ids[gone], here[gone] = r, -1, -1
            if nxt < n:
                before[nxt] = i
                here[i] = q = pair(r << 32 | ids[nxt], -1)
                if q >= 0:
                    heappush(heap, q << 32 | i)
            else:
                here[i] = -1
            prev = before[i]
            if prev >= 0:
                here[prev] = q = pair(ids[prev] << 32 | r, -1)
                if q >= 0:
                    heappush(heap, q << 32 | prev)
        return [t for t in ids if t >= 0]

    def piece(self, text: str) -> bytes:
        """Little-endian ids of a pre-token: whole if the vocabulary has it, else merged."""
        raw = text.encode()
        whole = self.whole.get(raw)
        return whole.to_bytes(4, "little") if whole is not None else b"".join([t.to_bytes(4, "little") for t in self.merge(raw)])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [(self.full if PLAIN.search(t) else self.plain).findall(t) for t in texts]
        known = self.known
        fresh = set().union(*cut).difference(known)
        if len(known) + len(fresh) > KEPT:
            known = self.known = {}
            fresh = set().union(*cut)
        piece = self.piece
        for p in fresh:
            known[p] = piece(p)
        get = known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> tuple[bytes, ...]:
    """Tokens of a rank file in rank order."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not gapless")
    return tuple(ranks[i] for i in range(len(ranks)))


@lru_cache(2)
def coder(tokens: tuple[bytes, ...], pattern: str) -> Bpe:
    """One coder for each vocabulary and worker."""
    return Bpe(tokens, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, ids binary, decoded binary``; with ``digests`` the SHA-256 of
    both (``ids_sha256, decoded_sha256``) in their place.

    ``ids`` are little-endian unsigned 32-bit integers. ``vocabulary`` is a rank file that the driver reads; its tokens
    (bounded by the file) go to every task. A null text is empty and has no ids. Repeated rows give repeated results, an
    empty table none. Other columns are dropped. Texts are encoded whole, however long their pre-tokens are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    last = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches):
        bpe = coder(shared.value, pattern)
        for batch in batches:
            texts = text_list(batch.column(1))
            n, a_col, b_col = [], [], []
            for a, b in steps([len(t) for t in texts]):
                for ids in bpe.encode(texts[a:b]):
                    back = bpe.decode(ids)
                    n.append(len(ids) // 4)
                    a_col.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                    b_col.append(hashlib.sha256(back).hexdigest() if digests else back)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a_col, kind), pa.array(b_col, kind)],
                                             names=["doc_id", "n_tokens", *last])

    kind = "string" if digests else "binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id long, n_tokens long, {last[0]} {kind}, {last[1]} {kind}")


def decode(coded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded binary``: the bytes of each row's ids; null ids are empty."""
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        bpe = coder(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())],
                                             names=["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


@query("op5_byte_bpe")
def op5(spark, sf):
    """Every document encoded with the many-language ranks, and decoded again."""
    import public_tokenizers as tok
    return encode(table(spark, sf, "documents"), tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN, digests=True)

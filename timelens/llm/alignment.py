"""Alignment of two tokenizers over a corpus, with corpus-wide counts of token pairs.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; tokens whose byte ranges overlap are linked. First pass:
every task counts, for the pairs of ids it meets, the documents that hold them. The distinct pairs are dealt into shards, each with a
minimal perfect hash; counts are dense vectors in the order of the hash, summed over tasks as a tree. The first pass also writes each
document's counts, groups and linked pairs, so texts are encoded once. Second pass: documents' pairs look their counts up, each answer
verified by the stored key. Pairs beyond ``held_pairs`` of the most frequent
ones are not sent to the tasks: their few links meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import LETTERS, PLAIN
from .common import mix64, query, sizes, steps, table, text_list
from .packing import Tokenizer

#: Pairs of a shard, rows of partial counts that one task turns into a vector, pairs sent to every task.
SHARD_PAIRS, VECTOR_ROWS, HELD_PAIRS = 1 << 16, 1 << 20, 1 << 20
#: Pairs that a task of the first pass counts before it hands them on, bytes of text it works on at a time.
TASK_PAIRS, BATCH_BYTES = 1 << 20, 1 << 20
#: Both tokenizers end a token before a space that follows one of these characters, so texts are cut there. Cuts that one worker keeps,
#: and the longest that it keeps.
CUT, MAY_END = re.compile(rf"(?<=[!-~{LETTERS[6:]}])(?= )"), re.compile(rf"[!-~{LETTERS[6:]}]")
KEPT_CUTS, LONGEST_KEPT = 400_000, 48
#: Types that a document's pairs and their times are written as, the narrowest that holds them; documents that are looked up at a time.
PAIR, TIMES, LOOKED_UP = (np.int64,), (np.uint8, np.uint16, np.int64), 512
SLOTS_PER_KEY, LEVELS = 2.0, 40


class PairHash:
    """Minimal perfect hash of distinct 64-bit keys by levels of collision-free slots.

    At each level keys that share a slot with no other key get it; the others go on to the next level with another hash. A key's number
    is the count of taken slots before its own. Unknown keys are told by comparing the stored key.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.int64))
        self.words, self.before, self.width = [], [], []
        left, taken = keys, 0
        for level in range(LEVELS):
            if not len(left):
                break
            width = max(64, int(len(left) * SLOTS_PER_KEY) | 63)
            slot = self._slot(left, level, width)
            once = np.bincount(slot, minlength=width) == 1
            bits = np.zeros(-(-width // 64) * 64, np.uint8)
            bits[:width] = once
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(taken + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.width.append(width)
            taken += int(once.sum())
            left = left[~once[slot]]
        if len(left):
            raise ValueError("keys do not separate")
        self.key = np.zeros(len(keys), np.int64)
        self.key[self._number(keys)] = keys

    @staticmethod
    def _slot(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix64(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(width)).astype(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, before, width) in enumerate(zip(self.words, self.before, self.width)):
            if not len(todo):
                break
            slot = self._slot(keys[todo], level, width)
            word, bit = slot >> 6, (slot & 63).astype(np.uint64)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[todo[hit]] = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            todo = todo[~hit]
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where it is not one of the set."""
        if not len(self.key):
            return np.full(len(keys), -1, np.int64)
        n = self._number(keys)
        return np.where((n >= 0) & (self.key[np.maximum(n, 0)] == keys), n, -1)


class Aligner:
    """Encodes with both tokenizers. A: a byte-level BPE file, with a space before the text; B: a SentencePiece model that adds it itself."""

    def __init__(self, file_a: str, model_b: bytes):
        import sentencepiece
        self.a = Tokenizer(file_a)
        self.a.library.encode_special_tokens = True
        chars = Tokenizer.byte_chars()
        vocab = json.loads(file_a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        #: No piece holds a space after another character, so pieces never reach over a cut.
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(n) if not self.b.is_control(i))
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Decimal ids behind each of the separators that may stand before them.
        self.text_a = [s + str(i) for s in (",", ";") for i in range(len(self.bytes_a))]
        self.text_b = [s + str(i) for s in (",", "|") for i in range(n)]

    def ids_a(self, text: str) -> list[int]:
        if self.a.fast and not PLAIN.search(text):
            return self.a.fast.encode_ordinary(text)
        return self.a.library.encode(text, add_special_tokens=False).ids

    def flat_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. Plain texts that end where a cut may follow are encoded as one."""
        if self.a.fast and len(texts) > 1:
            whole = "".join(texts)
            if not PLAIN.search(whole) and all(map(MAY_END.match, [t[-1] for t in texts[:-1]])):
                ids = np.array(self.a.fast.encode_ordinary(whole), np.int64)
                stops = np.searchsorted(np.cumsum(self.size_a[ids]), np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts])) + 1
                return ids, np.diff(stops, prepend=0)
        many = [*map(self.ids_a, texts)]
        return np.fromiter(chain.from_iterable(many), np.int64), np.array([*map(len, many)], np.int64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Ids of both for texts that begin with a space, all in a row, and how many each text has; last, the texts whose bytes a
        tokenizer does not give back: they get no ids."""
        many = self.b.encode([t[1:] for t in texts], num_threads=1)
        b, nb = np.fromiter(chain.from_iterable(many), np.int64), np.array([*map(len, many)], np.int64)
        a, na = self.flat_a(texts)
        raw = [t.encode() for t in texts]
        ends, whole = np.cumsum([*map(len, raw)]), b"".join(raw)
        checks = (self.bytes_a, self.size_a, a, na), (self.bytes_b, self.size_b, b, nb)
        if all(b"".join(map(bytes_of.__getitem__, ids.tolist())) == whole and (np.cumsum(size[ids])[np.cumsum(n) - 1] == ends).all()
               for bytes_of, size, ids, n in checks if texts):
            return a, na, b, nb, []
        bad = set()
        for bytes_of, _, ids, n in checks:
            at = 0
            for i, (r, k) in enumerate(zip(raw, n.tolist())):
                if b"".join(map(bytes_of.__getitem__, ids[at:at + k].tolist())) != r:
                    bad.add(i)
                at += k
        good = ~np.isin(np.arange(len(texts)), [*bad])
        return a[np.repeat(good, na)], na * good, b[np.repeat(good, nb)], nb * good, sorted(bad)

    def links(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray):
        """(text, pair, times) of each distinct linked pair, sorted by text; the groups of each text; where tokens and groups end.

        Tokens of both tile the same bytes, so each stretch between neighbouring ends of either belongs to one link and to no other.
        """
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        text_of = np.repeat(np.arange(len(na)), na)
        pair, which = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        cell, times = np.unique(text_of[at_a] * max(1, len(pair)) + which, return_counts=True)
        text, which = np.divmod(cell, max(1, len(pair)))
        common = end_a[np.isin(end_a, end_b, assume_unique=True)]
        stop = np.concatenate([[0], end_a])[np.concatenate([[0], np.cumsum(na)])]
        groups = np.diff(np.searchsorted(common, stop, "right"))
        return text, pair[which], times, groups, (end_a, end_b, common)

    def group_texts(self, a, na, b, nb, parts) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        end_a, end_b, common = parts
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        first_a = np.diff(group_a, prepend=-1) != 0
        first_b = np.diff(group_b, prepend=-1) != 0
        shown = np.array(self.text_a, object)[a + first_a * len(self.bytes_a)], np.array(self.text_b, object)[b + first_b * len(self.bytes_b)]
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        flat = np.concatenate(shown)[order]
        stops = np.cumsum(na + nb)
        return ["".join(flat[s - n:s])[1:] for s, n in zip(stops.tolist(), (na + nb).tolist())]


class Cuts:
    """Alignments of the stretches between cuts, each made once while it is kept.

    A stretch has its counts of tokens and groups, its groups as text, and its linked pairs (numbers into ``pairs``) with how often each occurs.
    """

    def __init__(self, al: Aligner, shown: bool):
        self.al, self.shown = al, shown
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pair_number: dict[int, int] = {}
        self.text: list[str] = []
        self.pairs = np.zeros(0, np.int64)
        self.sizes = np.zeros((3, 0), np.int64)
        self.start, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, fresh: list[str]) -> set[str]:
        """Align new stretches; those that do not come back byte for byte are returned (and count as empty)."""
        a, na, b, nb, bad = self.al.tokens(fresh)
        which, pair, times, groups, parts = self.al.links(a, na, b, nb)
        base = self.sizes.shape[1]
        self.number.update(zip(fresh, range(base, base + len(fresh))))
        if self.shown:
            self.text += self.al.group_texts(a, na, b, nb, parts)
        known = self.pair_number
        met, inv = np.unique(pair, return_inverse=True)
        at = np.array([known.setdefault(p, len(known)) for p in met.tolist()], np.int32)
        self.pairs = np.fromiter(known, np.int64, len(known))
        self.sizes = np.concatenate([self.sizes, [na, nb, groups]], 1)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(which, minlength=len(fresh)))])
        self.pair, self.times = np.concatenate([self.pair, at[inv]]), np.concatenate([self.times, times.astype(np.int32)])
        return {fresh[i] for i in bad}

    def align(self, texts: list[str]):
        """(document, pair number, times) of each distinct linked pair; tokens of A, of B and groups of each document; its groups as
        text, where wanted; the pairs that the numbers stand for."""
        cut = [(CUT.split(" " + t) if self.al.cuts else [" " + t]) if t else [] for t in texts]
        if len(self.number) > KEPT_CUTS:
            self.clear()
        fresh = sorted(set().union(*cut).difference(self.number))
        bad = self.add(fresh)
        passing = bad | {x for x in fresh if len(x) > LONGEST_KEPT}
        if bad:
            # The whole text decides whether the bytes come back.
            whole = [i for i, c in enumerate(cut) if not bad.isdisjoint(c)]
            for i in whole:
                cut[i] = [" " + texts[i]]
            passing.update(cut[i][0] for i in whole)
            fresh = sorted({cut[i][0] for i in whole}.difference(self.number))
            if fresh:
                self.add(fresh)
        n = np.array([*map(len, cut)], np.int64)
        flat = [*map(self.number.__getitem__, chain.from_iterable(cut))]
        part, doc, stops = np.array(flat, np.int64), np.repeat(np.arange(len(cut)), n), np.cumsum(n).tolist()
        sums = [np.bincount(doc, row[part], len(cut)).astype(np.int64) for row in self.sizes]
        shown = None
        if self.shown:
            get = self.text.__getitem__
            shown = [";".join(map(get, flat[b - a:b])) for a, b in zip(map(len, cut), stops)]
        # Stretches of one document are put together first, then their pairs.
        width = self.sizes.shape[1]
        cell, often = np.unique(doc * width + part, return_counts=True)
        doc, part = np.divmod(cell, max(1, width))
        size = self.start[part + 1] - self.start[part]
        at = np.repeat(self.start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        width = max(1, len(self.pairs))
        cell, which = np.unique(np.repeat(doc, size) * width + self.pair[at], return_inverse=True)
        total = np.bincount(which, self.times[at] * np.repeat(often, size), len(cell)).astype(np.int64)
        # Long stretches and such as did not come back are not kept: no text finds their place again.
        for x in passing:
            self.number.pop(x, None)
        return *np.divmod(cell, width), total, *sums, shown, self.pairs


@lru_cache(1)
def aligner(file_a: str, model_b: bytes) -> Aligner:
    return Aligner(file_a, model_b)


def _encoded(docs: DataFrame, shared, task_pairs: int, whole: bool) -> DataFrame:
    """Rows of kind 0: a document with its counts, its groups (their SHA-256 without ``whole``) and its distinct linked pairs, how often each
    occurs beside them; of kind 1: ``pair, docs``, documents of a task that hold the pair. A task hands on at most about
    ``task_pairs`` pairs at a time.
    """
    def run(batches):
        cuts, part, n = Cuts(aligner(*shared.value), True), TaskContext.get().partitionId() << 36, 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def counted():
            m, none = len(keys), [None] * len(keys)
            longs, raw = pa.array(none, pa.int64()), pa.array(none, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), longs, longs, longs, longs, longs, pa.array(none, pa.string()), raw, raw, pa.array(keys), pa.array(counts)], names=names)

        for batch in batches:
            ids, texts = batch.column(0), text_list(batch.column(1))
            for s, e in steps([len(t) for t in texts], BATCH_BYTES):
                doc, which, times, na, nb, groups, shown, pairs = cuts.align(texts[s:e])
                here = np.bincount(which, minlength=len(pairs))
                met = np.flatnonzero(here)
                keys, inv = np.unique(np.concatenate([keys, pairs[met]]), return_inverse=True)
                counts = np.bincount(inv, np.concatenate([counts, here[met]]), len(keys)).astype(np.int64)
                k = e - s
                rid = part + n + np.arange(k)
                n += k
                final = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in shown] if not whole else shown
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=k))])
                none = pa.array([None] * k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(k, np.int32)), pa.array(rid), ids[s:e], pa.array(na), pa.array(nb), pa.array(groups), pa.array(final, pa.string()),
                     _packed(pairs[which], ends, PAIR), _packed(times, ends, TIMES), none, none], names=names)
                if len(keys) > task_pairs:
                    yield counted()
                    keys, counts = keys[:0], counts[:0]
        yield counted()

    names = ["kind", "rid", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times", "pair", "docs"]
    return docs.select("doc_id", "text").mapInArrow(
        run, "kind int, rid long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary, pair long, docs long")


def _packed(values: np.ndarray, ends: np.ndarray, kinds: tuple) -> pa.Array:
    """Binary column of runs of whole numbers that end at ``ends``: a byte that names the type, the narrowest of ``kinds`` that holds the batch, then the run."""
    code = next(i for i, t in enumerate(kinds) if values.max(initial=0) <= np.iinfo(t).max)
    raw = values.astype(kinds[code]).tobytes()
    width = np.dtype(kinds[code]).itemsize
    return pa.array([bytes([code]) + raw[a * width:b * width] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def _load(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def pair_counts(partial: DataFrame, shard_pairs: int = SHARD_PAIRS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """``pair, docs`` summed over all partial counts, one row a distinct pair.

    Each shard has at most about ``shard_pairs`` pairs and a minimal perfect hash of them; partial counts of a shard become dense vectors in
    as many tasks as their rows ask for, and the vectors are summed in two steps.
    """
    keys = materialize(partial.select("pair").distinct(), "pair_keys")
    n = keys.count()
    shards = max(1, -(-n // shard_pairs))
    splits = max(1, -(-partial.count() // (shards * vector_rows)))
    shard = F.pmod(F.xxhash64("pair"), F.lit(shards)).alias("shard")

    def build(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group["shard"].slice(0, 1), "keys": pa.array([PairHash(group["pair"].to_numpy()).key.tobytes()], pa.binary())})

    hashes = materialize(keys.select("pair", shard).groupBy("shard").applyInArrow(build, "shard long, keys binary"), "pair_hashes")

    def vector(part: pa.Table, known: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "vector": pa.array([], pa.binary())})
        mph = PairHash(_load(known["keys"][0].as_py()))
        at = mph.numbers(part["pair"].to_numpy())
        if (at < 0).any():
            raise ValueError("a pair is not among the distinct pairs")
        dense = np.bincount(at, part["docs"].to_numpy(), len(mph.key)).astype(np.int64)
        return pa.table({"shard": part["shard"].slice(0, 1), "vector": pa.array([dense.tobytes()], pa.binary())})

    def total(vectors: pa.Table, known: pa.Table) -> pa.Table:
        key = _load(known["keys"][0].as_py())
        dense = sum((_load(v) for v in vectors["vector"].to_pylist()), np.zeros(len(key), np.int64))
        return pa.table({"pair": pa.array(key), "docs": pa.array(dense)})

    split = F.pmod(F.monotonically_increasing_id(), F.lit(splits)).alias("split")
    left = partial.select("pair", "docs", shard, split)
    right = hashes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("split"), "keys")
    sums = left.groupBy("shard", "split").cogroup(right.groupBy("shard", "split")).applyInArrow(vector, "shard long, vector binary")
    # With many splits the vectors are first added in groups of 64.
    wide = 64
    while splits > wide:
        splits = -(-splits // wide)
        def add(group: pa.Table) -> pa.Table:
            dense = sum(map(_load, group["vector"].to_pylist()))
            return pa.table({"shard": group["shard"].slice(0, 1), "vector": pa.array([dense.tobytes()], pa.binary())})
        sums = sums.withColumn("split", F.pmod(F.monotonically_increasing_id(), F.lit(splits))).groupBy("shard", "split").applyInArrow(add, "shard long, vector binary")
    return sums.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(total, "pair long, docs long")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _unpacked(column: pa.Array, kinds: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The runs of such a column in a row, and the length of each."""
    runs = [np.frombuffer(x, kinds[x[0]], offset=1) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *runs]).astype(np.int64), np.array([*map(len, runs)], np.int64)


def _looked_up(encoded: DataFrame, held, last: str) -> DataFrame:
    """Rows of kind 0: a document with what the held pairs give; of kind 1: a document's links to a pair that is not held."""
    def run(batches):
        keys, docs_of, best = held.value
        mph, dense = _held(keys.tobytes(), docs_of.tobytes())
        i64 = pa.int64()
        for batch in (b.slice(at, LOOKED_UP) for b in batches for at in range(0, b.num_rows, LOOKED_UP)):
            rid, (pairs, n_pairs), (times, _) = batch.column(0).to_numpy(), _unpacked(batch.column(6), PAIR), _unpacked(batch.column(7), TIMES)
            k = batch.num_rows
            doc = np.repeat(np.arange(k), n_pairs)
            met, which = np.unique(pairs, return_inverse=True)
            at = mph.numbers(met)
            count_of = np.where(at >= 0, dense[np.maximum(at, 0)] if len(dense) else 0, 0)
            known, count = (at >= 0)[which], count_of[which]
            is_best = known & (count == best[pairs >> 32])
            n_best = np.bincount(doc, times * is_best, k).astype(np.int64)
            # Sums of whole numbers beyond 2^53 would be rounded by bincount's weights.
            count_sum = np.zeros(k, np.int64)
            np.add.at(count_sum, doc, times * count)
            na, nb, groups = (batch.column(i).to_numpy() for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), pa.array(rid), batch.column(1), pa.array(na), pa.array(nb), pa.array(groups), pa.array(na + nb - groups), pa.array(n_best),
                 pa.array(count_sum), batch.column(5).cast(pa.string()), pa.array([None] * k, i64)], names=names)
            m = int((~known).sum())
            if m:
                none = pa.array([None] * m, i64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int32)), pa.array(rid[doc[~known]]), none, none, none, none, pa.array(times[~known]), none, none, pa.array([None] * m, pa.string()),
                     pa.array(pairs[~known])], names=names)

    names = ["kind", "rid", *COLUMNS, last, "pair"]
    return (encoded.where("kind = 0").select("rid", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times")
            .mapInArrow(run, f"kind int, rid long, {', '.join(f'{c} long' for c in COLUMNS)}, {last} string, pair long"))


@lru_cache(1)
def _held(keys: bytes, counts: bytes):
    key, count = _load(keys), _load(counts)
    mph = PairHash(key)
    dense = np.zeros(len(key), np.int64)
    dense[mph.numbers(key)] = count
    return mph, dense


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = HELD_PAIRS,
          shard_pairs: int = SHARD_PAIRS, vector_rows: int = VECTOR_ROWS, task_pairs: int = TASK_PAIRS, whole: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``; without ``whole`` the
    SHA-256 of ``groups`` as ``groups_sha256`` in its place ('' stays '').

    A text that is null or empty, or that a tokenizer does not give back byte for byte, has no tokens: zeros and ''. Repeated rows count
    as documents of their own. An empty table gives no rows. Other columns are dropped, whatever their names.

    Sent to every task: both tokenizer files, the best count of each id of A (bounded by the vocabulary) and at most ``held_pairs``
    pairs with their counts, the most frequent ones; links to other pairs are joined with the counts, and since those pairs are the
    rarest, no key of that join is hot.
    """
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        files = f.read(), g.read()
    shared = spark.sparkContext.broadcast(files)
    vocabulary = 1 + max(json.loads(files[0])["model"]["vocab"].values())
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = materialize(_encoded(chosen, shared, task_pairs, whole), "pair_encoded")
    counts = materialize(pair_counts(encoded.where("kind = 1").select("pair", "docs"), shard_pairs, vector_rows), "pair_counts")

    a_id = F.shiftright("pair", 32).alias("a")
    best = np.zeros(vocabulary, np.int64)
    top = counts.groupBy(a_id).agg(F.max("docs").alias("best"))
    for row in top.toLocalIterator():
        best[row.a] = row.best
    # Pairs from this count on are held: at most held_pairs, found among powers of two.
    powers = {r.p: r["count"] for r in counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("p")).count().collect()}
    least, room = 64, held_pairs
    while least > 0 and powers.get(least - 1, 0) <= room:
        least -= 1
        room -= powers.get(least, 0)
    is_held = F.floor(F.log2("docs")) >= least
    sent = counts.where(is_held).toArrow()
    held = spark.sparkContext.broadcast((sent["pair"].to_numpy(), sent["docs"].to_numpy(), best))

    made = materialize(_looked_up(encoded, held, "groups" if whole else "groups_sha256"), "alignments")
    first = made.where("kind = 0").drop("kind", "pair")
    if least == 0:
        return first.drop("rid")
    rare = (made.where("kind = 1").select("rid", "pair", F.col("n_links").alias("times")).join(counts.where(~is_held), "pair").withColumn("a", a_id)
            .join(F.broadcast(top), "a").groupBy("rid").agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                                            F.sum(F.col("times") * F.col("docs")).alias("more_sum")))
    more = {"n_best": "more_best", "count_sum": "more_sum"}
    return first.join(rare, "rid", "left").select(*[(F.col(c) + F.coalesce(more[c], F.lit(0))).alias(c) if c in more else c for c in first.columns if c != "rid"])


@query("op11_tokenizer_alignment")
def op11(spark, sf):
    """Every document aligned between the byte-level and the piece vocabulary."""
    import public_tokenizers as tok
    return align(table(spark, sf, "documents"), tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model"), whole=False)

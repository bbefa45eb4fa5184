"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's full windows leave at once; its rest goes into the open
window it fits best. If it fits none, the fullest window leaves; a gap of more than ``max_pad`` tokens in it is first filled
with the head of the rest. What is open at the end of a partition is merged in a second pass: the leftovers of ``fan_in``
partitions are packed again by the same rule and then joined end to end, so that one window of each such group is partial.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import PLAIN
from .common import query, table, text_list

SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: First sequence ids of the second pass; the first pass has the partition number in the bits below.
MERGED = 1 << 62
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Tokenizer:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where the file is a plain byte-level BPE whose ids follow its merges, common texts (no special token, ordinary letters)
    go through a faster coder with the same ranks; the rest goes through the library itself.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer as Library
        self.library = Library.from_str(file)
        self.fast = None
        spec = json.loads(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" \
            and not spec.get("normalizer") and not model.get("dropout")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        if plain:
            import tiktoken
            chars = self.byte_chars()
            ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if all(c in chars for c in t) and not self.special.fullmatch(t)}
            merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            order = [model["vocab"].get(m, -1) for m in merged]
            if len({*ranks.values()}) == len(ranks) and all(a < b for a, b in zip(order, order[1:])):
                self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def byte_chars() -> dict[str, int]:
        """The printable character that stands for each byte in such files."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not PLAIN.search(text) and not self.special.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(2)
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


class Packer:
    """Open windows of one task. ``done`` gets (document, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, size: int, n_open: int, max_pad: int, first_id: int):
        self.size, self.n_open, self.max_pad, self.next_id = size, n_open, max_pad, first_id
        self.open: list[list] = []  # [free tokens, pieces]
        self.done: list[tuple] = []

    def emit(self, pieces) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        size = self.size
        while len(ids) >= size:
            self.emit([(doc, start, ids[:size], total)])
            start, ids = start + size, ids[size:]
        while len(ids):
            n = len(ids)
            fit = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.n_open:
                fit = [size, []]
                self.open.append(fit)
            if fit is not None:
                fit[1].append((doc, start, ids, total))
                fit[0] -= n
                if not fit[0]:
                    self.leave(fit)
                return
            full = min(self.open, key=lambda w: w[0])
            if full[0] > self.max_pad:
                head = full[0]
                full[1].append((doc, start, ids[:head], total))
                start, ids = start + head, ids[head:]
            self.leave(full)

    def leave(self, window) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1])

    def close(self) -> None:
        """Join what is open end to end, fullest first; only the last sequence is partial."""
        free, out = self.size, []
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            for doc, start, ids, total in pieces:
                while len(ids):
                    part = ids[:free]
                    out.append((doc, start, part, total))
                    start, ids, free = start + len(part), ids[len(part):], free - len(part)
                    if not free:
                        self.emit(out)
                        free, out = self.size, []
        if out:
            self.emit(out)
        self.open = []


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, n_open: int = 32, max_pad: int = 16, fan_in: int = 16,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """All rows packed: one row a piece with ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, ``ids`` (little-endian unsigned 32-bit, binary).

    A document is its text's ids and ``end_id``; a null text is empty, so that its one token is ``end_id``. Long documents
    are cut into as many windows as they need. Repeated rows and ids are packed as separate documents; an empty table
    gives no rows. Other columns are dropped. A task holds ``n_open`` windows and one batch of texts, whatever the input.
    A task that runs again makes the same sequences, since ids come from the partition's number and order.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(done, part: int, kind: int, keep: bool) -> pa.RecordBatch:
        doc, start, ids, total, seq, off = zip(*done) if done else [[]] * 6
        raw = [x.tobytes() for x in ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()),
             pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(raw if keep else [None] * len(raw), pa.binary()),
             pa.array([kind] * len(raw), pa.int32()), pa.array([part] * len(raw), pa.int64())], names=[*COLUMNS, "ids", "kind", "part"])

    def first(batches):
        tok, part = tokenizer(shared.value), TaskContext.get().partitionId()
        packer, end = Packer(size, n_open, max_pad, part << 36), np.array([end_id], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_list(batch.column(1))):
                ids = np.concatenate([tok.ids(text), end])
                packer.add(doc, 0, ids, len(ids))
                if len(packer.done) >= 4096:
                    yield rows(packer.done, part, 0, with_ids)
                    packer.done = []
        yield rows(packer.done, part, 0, with_ids)
        left, packer.open, packer.done = packer.open, [], []
        for _, pieces in left:
            packer.emit(pieces)
        yield rows(packer.done, part, 1, True)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "part", "sequence_id", "offset"], ascending=[False, True, True, True])
        packer = Packer(size, n_open, max_pad, MERGED | int(pdf["part"].iloc[0]) // fan_in << 24)
        for doc, start, ids, total in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"]):
            packer.add(None if pd.isna(doc) else int(doc), int(start), np.frombuffer(ids, "<u4"), int(total))
        packer.close()
        return rows(packer.done, 0, 2, with_ids).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, kind int, part long"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialize(source.mapInArrow(first, schema), "packed")
    leftovers = made.where("kind = 1").groupBy(F.floor(F.col("part") / fan_in).alias("g")).applyInPandas(merge, schema)
    return made.where("kind = 0").unionByName(leftovers).select(*COLUMNS, *["ids"] * with_ids)


@query("op2_packing_bounded_space")
def op2(spark, sf):
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers as tok
    return pack(table(spark, sf, "documents"), tok.path("byte_bpe_50k.json"), with_ids=False)

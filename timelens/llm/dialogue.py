"""Conversation structure repair by depth-first branch and bound.

A conversation's rows get faults; the cheapest edits (keep, rerole, delete, insert) that turn its roles into
``(s?(ua)+)?`` are searched with an explicit stack. A lower bound of every suffix comes from a looser grammar (any number of
leading system rows, pairs optional), the incumbent is the best (cost, audit) found, and a table of the best prefix at each
node (row, state) drops worse ones; the search ends when the stack is empty, so the incumbent is proved best.

Rows are dealt over tasks by ranges of (conversation, turn). Conversations that lie inside one task are finished there. Those at
the edge of a task, and with them any conversation that fills many tasks, are cut into segments: each segment is searched
for every pair of start and end state, and the segments are joined in order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row. The first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = "x"
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
#: Rows of one search; longer conversations are joined from several.
SEGMENT = 256
LEGAL = {"su", "ua", "au"}


def bounds(signature: str, goals: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For each row and state, the least cost of all that follows under the looser grammar ``s*(ua)*``."""
    def closed(p, u, a):
        """An inserted row leads from one state to the next."""
        u = min(u, INSERT + a)
        p, a = min(p, INSERT + u), min(a, INSERT + u)
        return p, min(u, INSERT + a), a

    far = 1 << 40
    p, u, a = closed(*[0 if any(g in goals for g in part) else far for part in ((START, SYSTEM), (USER,), (ASSISTANT,))])
    out = [(p, p, u, a)]
    for c in reversed(signature):
        if c == FORCED:
            p, u, a = p + DELETE, u + DELETE, a + DELETE
        else:
            extra, who = UNFINISHED * c.isupper(), c.lower()
            p1 = min(DELETE + p, REROLE + extra + u, extra + (p if who == "s" else u if who == "u" else far))
            u1 = min(DELETE + u, REROLE + extra + a, extra + (a if who == "a" else far))
            a1 = min(DELETE + a, REROLE + extra + u, extra + (u if who == "u" else far))
            p, u, a = closed(p1, u1, a1)
        out.append((p, p, u, a))
    return out[::-1]


@lru_cache(200_000)
def search(signature: str, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Cheapest (cost, audit) from ``start`` over all rows of ``signature`` to a goal, ties to the least audit; None if there is none.

    ``signature`` has a letter a row: ``x`` must go; ``s u a`` by role, ``o`` another role; a capital letter is a row without an end.
    """
    n, least = len(signature), bounds(signature, goals)
    best: tuple[int, str] | None = None
    table_: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        total = cost + least[i][state]
        if total >= 1 << 40 or best and (total > best[0] or total == best[0] and audit > best[1][:len(audit)]):
            continue
        known = table_.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        table_[i, state] = cost, audit
        if i == n and state in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        nxt = ASSISTANT if state == USER else USER
        ways = [(cost + INSERT, "I", i, nxt)]
        if i < n:
            c = signature[i]
            ways.append((cost + DELETE, "D", i + 1, state))
            if c != FORCED:
                extra = UNFINISHED * c.isupper()
                ways.append((cost + REROLE + extra, "R", i + 1, nxt))
                kept = KEEPS.get((state, c.lower()))
                if kept is not None:
                    ways.append((cost + extra, "K", i + 1, kept))
        ways.sort(key=lambda w: (w[0] + least[w[2]][w[3]], w[1]), reverse=True)
        stack += [(j, s, c, audit + symbol) for c, symbol, j, s in ways]
    return best


class Chain:
    """Segments joined in order: the best (cost, audit) that reaches each state so far.

    Of two prefixes of equal cost that end in the same state none is the start of the other (it would cost less), so the smaller one
    stays smaller whatever follows. What all prefixes share is put aside.
    """

    def __init__(self):
        self.reached: dict[int, tuple[int, str]] = {START: (0, "")}
        self.settled: list[str] = []

    def add(self, paths: list[tuple[int, int, int, str]]) -> None:
        """``paths``: (start, end, cost, audit) of the next segment."""
        out: dict[int, tuple[int, str]] = {}
        for start, end, cost, audit in paths:
            if start in self.reached:
                before, so_far = self.reached[start]
                new = before + cost, so_far + audit
                if end not in out or new < out[end]:
                    out[end] = new
        shared = commonprefix([a for _, a in out.values()])
        self.settled.append(shared)
        self.reached = {s: (c, a[len(shared):]) for s, (c, a) in out.items()}

    def result(self) -> tuple[int, str]:
        """The best end; a missing tail is inserted."""
        ends = []
        for state, (cost, audit) in self.reached.items():
            tail = search("", state, ENDS)
            ends.append((cost + tail[0], audit + tail[1]))
        cost, audit = min(ends)
        return cost, "".join([*self.settled, audit])


def paths(signature: str, starts=range(4)) -> list[tuple[int, int, int, str]]:
    found = [(s, g, search(signature, s, (g,))) for s in starts for g in range(4)]
    return [(s, g, *x) for s, g, x in found if x is not None]


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(signature) <= SEGMENT:
        return search(signature, START, ENDS)
    chain = Chain()
    for i in range(0, len(signature), SEGMENT):
        chain.add(paths(signature[i:i + SEGMENT], list(chain.reached)))
    return chain.result()


def letter(role: str, text: str, seen: bool) -> tuple[str, str]:
    """Signature letter and first fault (``blank``, ``duplicate``, ``truncated`` or none) of a row."""
    said = text.rstrip(BLANKS)
    if not said:
        return FORCED, "blank"
    if seen:
        return FORCED, "duplicate"
    who = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (who, "") if said[-1] in ".!?" else (who.upper(), "truncated")


class Counts:
    """Facts of consecutive rows that can be joined with those of the rows after them."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def row(self, turn, role: str, fault: str) -> None:
        mine = Counts()
        mine.first = mine.last = role[:1]
        mine.low, mine.high, mine.turns = turn, turn, int(turn is not None)
        if fault:
            setattr(mine, fault, 1)
        self.join(mine)

    def join(self, o) -> None:
        self.illegal += o.illegal + (self.last is not None and o.first is not None and self.last + o.first not in LEGAL)
        self.turns += o.turns - (self.high is not None and self.high == o.low)
        self.blank, self.duplicate, self.truncated = self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated
        self.first = o.first if self.first is None else self.first
        self.last = self.last if o.last is None else o.last
        self.low = o.low if self.low is None else self.low
        self.high = self.high if o.high is None else o.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Writer:
    """Applies an audit to rows given in order: digest of the repaired conversation, and its turns where they are wanted."""

    def __init__(self, audit: str, turns: bool):
        self.audit, self.at, self.state, self.turns = audit, 0, START, turns
        self.digest, self.n, self.out = hashlib.sha256(), 0, []

    def put(self, role: str, text: str, edit: str) -> None:
        self.digest.update((("\n" if self.n else "") + f"{role}:{text}").encode())
        if self.turns:
            self.out.append((self.n, role, text, edit))
        self.n += 1

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.forced("", "insert")
            self.at += 1

    def forced(self, text: str, edit: str) -> None:
        role, self.state = ("assistant", ASSISTANT) if self.state == USER else ("user", USER)
        self.put(role, text, edit)

    def row(self, role: str, text: str) -> None:
        self.inserted()
        symbol = self.audit[self.at]
        self.at += 1
        if symbol == "K":
            self.state = KEEPS[self.state, role[:1]]
            self.put(role, text, "keep")
        elif symbol == "R":
            self.forced(text, "rerole")

    def end(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
          ("audit", pa.string()), ("repaired_sha256", pa.string())]
TURN = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
EDGE = [("part", pa.int64()), ("idx", pa.int64()), ("turn", pa.int64()), ("same", pa.binary())]
SEGMENTS = [("facts", pa.string())]
#: What a row of the written table is: a finished conversation, one of its turns, a row or only the presence of an edge conversation.
FINISHED, REPAIRED, ROW, PRESENT = range(4)
FIELDS = pa.schema([("conv_id", pa.int64()), ("kind", pa.int32()), *RESULT, *TURN, *EDGE])
SPARK = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK[f.type]}" for f in schema)


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 2000, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, room = [], limit
    for r in rows:
        held.append(r)
        room -= len(r.get("text") or "")
        if len(held) >= size or room < 0:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, room = [], limit
    yield pa.RecordBatch.from_pylist(held, schema)


def rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            yield from batch.slice(a, 1000).to_pylist()


def finished(conv, counts: Counts, cost: int, writer: Writer) -> Iterator[dict]:
    for n, role, text, edit in writer.out:
        yield {"conv_id": conv, "kind": REPAIRED, "position": n, "role": role, "text": text, "edit": edit}
    writer.out = []
    yield {"conv_id": conv, "kind": FINISHED, "gaps": counts.gaps(), "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated,
           "illegal": counts.illegal, "cost": cost, "audit": writer.audit, "repaired_sha256": writer.end()} if not writer.turns else {"conv_id": conv, "kind": FINISHED}


def _inside(batches, turns: bool):
    """Sorted rows of a task: conversations that begin and end here are finished, the first and the last one are passed on."""
    part = TaskContext.get().partitionId()

    def done(conv, rows):
        seen, counts, signature = set(), Counts(), []
        for turn, role, text in rows:
            c, fault = letter(role, text, (role, text) in seen)
            seen.add((role, text))
            counts.row(turn, role, fault)
            signature.append(c)
        cost, audit = solve("".join(signature))
        writer = Writer(audit, turns)
        for _, role, text in rows:
            writer.row(role, text)
        writer.inserted()
        yield from finished(conv, counts, cost, writer)

    def edge(conv, rows, idx):
        yield {"conv_id": conv, "kind": PRESENT}
        for turn, role, text in rows:
            same = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            yield {"conv_id": conv, "kind": ROW, "part": part, "idx": idx, "turn": turn, "role": role, "text": text, "same": same}
            idx += 1

    def run():
        conv, rows, idx, begun, first = None, [], 0, False, True
        for r in rows_of(batches):
            if begun and r["conv_id"] != conv:
                yield from edge(conv, rows, idx) if first else done(conv, rows)
                idx, rows, first = idx + len(rows), [], False
            conv, begun = r["conv_id"], True
            rows += [(r["turn"], r["role"], r["text"])] * r["n"]
            if first and len(rows) >= 1000:
                yield from edge(conv, rows, idx)
                idx, rows = idx + len(rows), []
        if begun:
            yield from edge(conv, rows, idx)

    yield from batches_of(run(), FIELDS)


CUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("idx", pa.int64()), *SEGMENTS])


def _segments(batches):
    """Rows of edge conversations in order, a marker before each first occurrence: facts and all paths of each segment."""
    def closed(conv, part, idx, counts, signature):
        return {"conv_id": conv, "part": part, "idx": idx, "facts": json.dumps([vars(counts), paths("".join(signature))])}

    def run():
        place, signature, counts, idx, marked = None, [], Counts(), 0, False
        for r in rows_of(batches):
            if r["marker"]:
                marked = True
                continue
            here = r["conv_id"], r["part"]
            if signature and (here != place or len(signature) >= SEGMENT):
                yield closed(*place, idx, counts, signature)
                signature, counts = [], Counts()
            if not signature:
                place, idx = here, r["idx"]
            c, fault = letter(r["role"], r["ending"], not marked)
            marked = False
            counts.row(r["turn"], r["role"], fault)
            signature.append(c)
        if signature:
            yield closed(*place, idx, counts, signature)

    yield from batches_of(run(), CUT)


def _joined(batches, turns: bool):
    """For each edge conversation its segments in order, then its rows in order: the audit, then the repaired text as a stream."""
    def run():
        conv, chain, counts, writer, begun = None, Chain(), Counts(), None, False

        def decided():
            cost, audit = chain.result()
            return cost, Writer(audit, turns)

        cost = 0
        for r in rows_of(batches):
            if begun and r["conv_id"] != conv:
                if writer is None:
                    cost, writer = decided()
                writer.inserted()
                yield from finished(conv, counts, cost, writer)
                chain, counts, writer = Chain(), Counts(), None
            conv, begun = r["conv_id"], True
            if r["facts"]:
                facts, way = json.loads(r["facts"])
                more = Counts()
                vars(more).update(facts)
                counts.join(more)
                chain.add([tuple(p) for p in way])
            elif r["role"] is not None:
                if writer is None:
                    cost, writer = decided()
                writer.row(r["role"], r["text"])
                for n, role, text, edit in writer.out:
                    yield {"conv_id": conv, "kind": REPAIRED, "position": n, "role": role, "text": text, "edit": edit}
                writer.out = []
        if begun:
            if writer is None:
                cost, writer = decided()
            writer.inserted()
            yield from finished(conv, counts, cost, writer)

    yield from batches_of(run(), FIELDS)


def _solved(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None, turns: bool) -> DataFrame:
    blank = F.lit(" ")
    plain = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"),
                        F.coalesce(F.col(text_col), blank).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("n"))
    # Equal rows may be dealt to several tasks: they are interchangeable, so the last key is any number.
    keys = ["conv_id", "turn", "role", "h"]
    dealt = (plain.withColumn("h", F.xxhash64("text")).withColumn("any", F.monotonically_increasing_id())
             .repartitionByRange(*keys, "any").sortWithinPartitions(*keys, "text").drop("h", "any"))
    made = materialize(dealt.mapInArrow(lambda b: _inside(b, turns), ddl(FIELDS)), "repair_inside")

    edge = made.where(F.col("kind") == ROW)
    said = F.rtrim(F.translate("text", BLANKS, " " * len(BLANKS)))
    ending = edge.select("conv_id", "part", "idx", "turn", "role", "same", F.substring(said, -1, 1).alias("ending"), F.lit(1).alias("row"))
    firsts = (ending.groupBy("conv_id", "same").agg(F.min(F.struct("part", "idx")).alias("at"))
              .select("conv_id", "at.part", "at.idx", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                      F.lit(None).cast("string").alias("ending"), F.lit(0).alias("row")))
    marked = (ending.drop("same").unionByName(firsts).repartition("part").sortWithinPartitions("part", "idx", "row")
              .select("conv_id", "part", "idx", "turn", "role", "ending", (F.col("row") == 0).alias("marker")))
    cut = marked.mapInArrow(_segments, ddl(CUT))
    none = F.lit(None).cast("string")
    stream = (cut.select("conv_id", F.lit(0).alias("phase"), "part", "idx", "facts", none.alias("role"), none.alias("text"))
              .unionByName(edge.select("conv_id", F.lit(1).alias("phase"), "part", "idx", none.alias("facts"), "role", "text"))
              .unionByName(made.where(F.col("kind") == PRESENT).select("conv_id", F.lit(2).alias("phase"), "part", "idx", none.alias("facts"), "role", "text")))
    rest = (stream.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "part", "idx")
            .select("conv_id", "facts", "role", "text").mapInArrow(lambda b: _joined(b, turns), ddl(FIELDS)))
    return made.unionByName(rest)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies: Column | None = None) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A conversation is all rows of one id (rows without an id are one, too), in the order of turns, rows without a turn first; rows of
    one turn go by role, then by a digest of the text. A null role or text is one space. ``copies`` says how often a row stands there
    (default once; a row that stands nowhere still names its conversation). A row whose role is empty cannot be kept. An empty table gives
    no rows; other columns are dropped, whatever their names.

    A task holds its share of the sorted rows; a conversation that is spread over tasks is streamed, and only its audit (a letter a row) is
    held whole. Its SHA-256 is taken by one task, since that digest cannot be joined from parts.
    """
    done = _solved(rows, conv_col, turn_col, role_col, text_col, copies, turns=False)
    return done.where(F.col("kind") == FINISHED).select("conv_id", *[n for n, _ in RESULT])


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             copies: Column | None = None) -> DataFrame:
    """The repaired turns: ``conv_id, position, role, text, edit`` (``keep``, ``rerole`` or ``insert``); same rules as ``repair``."""
    done = _solved(rows, conv_col, turn_col, role_col, text_col, copies, turns=True)
    return done.where(F.col("kind") == REPAIRED).select("conv_id", *[n for n, _ in TURN])


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults planted by a checksum of id and turn; ``copies`` is 0, 1 or 2."""
    part = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.when(part == 4, "user").otherwise(role).alias("role"),
                       F.when(part == 1, "").when(part == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.when(part == 0, 0).when(part == 3, 2).otherwise(1).alias("copies"))


@query("op12_conversation_repair")
def op12(spark, sf):
    """Every conversation, damaged and repaired."""
    return repair(damage(table(spark, sf, "conversations")), copies=F.col("copies"))

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from timelens.llm import dialogue

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int, kind string"


def programme(signature, start=0, goals=(0, 3)):
    """Least (cost, audit) row by row, by a plain dynamic programme over states."""
    def with_inserts(best):
        for _ in range(4):
            for s in list(best):
                nxt, new = (3 if s == 2 else 2), (best[s][0] + 3, best[s][1] + "I")
                if nxt not in best or new < best[nxt]:
                    best[nxt] = new
        return best

    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = with_inserts({start: (0, "")})
    for c in signature:
        new = {}
        for s, (cost, audit) in best.items():
            ways = [(s, cost + 4, "D")]
            if c != "x":
                extra = 3 * c.isupper()
                ways.append((3 if s == 2 else 2, cost + 3 + extra, "R"))
                if (s, c.lower()) in keeps:
                    ways.append((keeps[s, c.lower()], cost + extra, "K"))
            for t, n, symbol in ways:
                if t not in new or (n, audit + symbol) < new[t]:
                    new[t] = n, audit + symbol
        best = with_inserts(new)
    found = [best[g] for g in goals if g in best]
    return min(found) if found else None


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        for _ in range(0 if part == 0 else 2 if part == 3 else 1):
            yield conv, turn, "user" if part == 4 else role, text


def expected(rows, all_ids, hashed):
    """``hashed`` orders rows of one turn and role as the operator does."""
    by: dict = {c: [] for c in all_ids}
    for r in rows:
        by[r[0]].append(r)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashed[r[3]], r[3]))
        seen, faults, signature = set(), [], ""
        for _, _, role, text in mine:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            c = role[:1] if role[:1] and role[:1] in "sua" else "o"
            signature += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit = programme(signature)
        turns = [t for _, t, _, _ in mine if t is not None]
        repaired, state, at = [], 0, iter(mine)
        for symbol in audit:
            _, _, role, text = next(at) if symbol != "I" else (None, None, None, "")
            if symbol in "IR":
                role = "assistant" if state == 2 else "user"
            if symbol != "D":
                repaired.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in repaired))
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def hashes(spark, rows):
    texts = sorted({r[3] for r in rows})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r[0]: r[1] for r in df.select("t", F.xxhash64("t")).collect()}


@pytest.mark.parametrize("alphabet", ["xsuaoSUAO", "ua", "sSu", "uUaAx", "xo"])
def test_search_finds_the_least(alphabet):
    rng = random.Random(alphabet)
    for _ in range(500):
        signature = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        start, goals = rng.choice([0, 0, 1, 2, 3]), rng.choice([(0, 3), (0,), (1,), (2,), (3,)])
        assert dialogue.search(signature, start, goals) == programme(signature, start, goals)


def test_segments_join_to_the_whole(monkeypatch):
    monkeypatch.setattr(dialogue, "SEGMENT", 4)
    rng = random.Random(8)
    for _ in range(300):
        signature = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 40)))
        assert dialogue.solve(signature) == programme(signature)


def test_long_conversations_end():
    for alphabet in ("xsuaoSUAO", "s", "uua", "oO"):
        rng = random.Random(alphabet)
        signature = "".join(rng.choice(alphabet) for _ in range(900))
        assert dialogue.solve(signature) == programme(signature)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["Hello there.", "Yes!", "no end", " ", "", "\t\n", "Why? ", "a.b", "Ünï?", "x" * 3000 + ".", None]
    out = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            if rng.random() < 0.9:
                out.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    out += [(None, t, rng.choice(["user", "assistant"]), f"text {t}.") for t in (None, None, 3, 5, 9)]
    out += [(77, t, ["user", "assistant"][t % 2], f"t {t % 50}.") for t in range(900)]
    out += [(78, 4, "user", "same.")] * 300 + [(79, None, None, None)] * 5
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_repair_against_brute_force(ready_spark, rows, parts):
    """Conversations inside a task, at its edges and over many tasks."""
    spark = ready_spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    frame = spark.createDataFrame([(*r, "c", 1, "k") for r in rows], SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = got(dialogue.repair(dialogue.damage(frame), copies=F.col("copies")))
        plain = got(dialogue.repair(frame))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    bad = list(damaged(rows))
    ids = {r[0] for r in rows}
    assert made == expected(bad, ids, hashes(spark, bad))
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert plain == expected(clean, ids, hashes(spark, clean))


def test_repaired_turns_have_the_digest(ready_spark, rows):
    frame = ready_spark.createDataFrame([(*r, "c", 1, "k") for r in rows], SCHEMA)
    turns: dict = {}
    for r in sorted(dialogue.repaired(frame).collect(), key=lambda r: (repr(r.conv_id), r.position)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.position == len(turns[r.conv_id]) - 1
    for r in dialogue.repair(frame).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(turns.get(r.conv_id, [])).encode()).hexdigest()


def test_query_against_brute_force(ready_spark):
    rows = list(map(tuple, ready_spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    bad = list(damaged(rows))
    assert got(dialogue.op12(ready_spark, SF)) == expected(bad, {r[0] for r in rows}, hashes(ready_spark, bad))


def test_empty(ready_spark):
    frame = ready_spark.createDataFrame([], SCHEMA)
    assert dialogue.repair(frame).count() == 0 and dialogue.repair(dialogue.damage(frame), copies=F.col("copies")).count() == 0

"""Counts of words, marks and runs of whole batches of texts in numpy, equal to the patterns of ``functions.text``."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Texts that are read at a time, characters of a word that are looked up at once.
AT_ONCE, PIECE = 128, 12
#: What a character is: part of a word, white space, part of a word in its lower case, part of a term.
WORD, BLANK, LOWER_WORD, TERM_PART = 1, 2, 4, 8
_CLASSES: dict = {}


def char_classes(spark: SparkSession) -> np.ndarray:
    """The bits of every code point, asked of the patterns' own engine once a session, so no Unicode version can differ."""
    key = spark.sparkContext.applicationId
    if key not in _CLASSES:
        def characters(batches):
            for batch in batches:
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([ids, pa.array([chr(i) for i in ids.to_pylist()])], names=["id", "c"])

        n, char = F.col("id"), F.col("c")
        bits = (F.when(char.rlike(r"(?U)^\w"), WORD).otherwise(0) + F.when(char.rlike(r"(?U)^\s"), BLANK).otherwise(0)
                + F.when(F.lower(char).rlike(r"(?U)^\w"), LOWER_WORD).otherwise(0) + F.when(char.rlike(r"^[\p{L}\p{N}\p{M}_]"), TERM_PART).otherwise(0))
        # Surrogates are no characters.
        every = spark.range(0x110000).filter((n < 0xD800) | (n > 0xDFFF)).mapInArrow(characters, "id long, c string")
        hits = (every.select(n, bits.cast("int").alias("bits")).filter("bits > 0")
                .groupBy("bits").agg(F.collect_list("id").alias("ids")).collect())
        table = np.zeros(0x110000, np.uint8)
        for r in hits:
            table[r["ids"]] = r["bits"]
        _CLASSES[key] = table
    return _CLASSES[key]


def text_reader(classes):
    """Functions (read, edges, borders, spans, kinds, tokens) over an Arrow array of texts, each ended by a line feed; ``classes`` is the broadcast table.

    Everything they need travels with them. Texts lie one after another as UTF-8; all bytes of a character have its class, so words, blanks and
    marks begin and end where they do by characters. ASCII apart, only two letters have ASCII ones in their lower case.
    """
    lower_bit = LOWER_WORD
    lowered = {"\u0130": "i\u0307", "\u212a": "k"}
    kinds = np.zeros(256, np.uint8)
    for letters, bit in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"'", 4), (b"aeiouyAEIOUY", 8), (b".!?", 16)):
        kinds[[*letters]] |= bit

    def marked(raw):
        """Class bits of every byte."""
        table = classes.value
        bits = table[:256].copy()
        bits[128:] = 0
        out = bits[raw]
        high = np.flatnonzero(raw >= 0xC2)
        if len(high):
            long = raw[high]
            n = 1 + (long >= 0xE0) + (long >= 0xF0)
            padded = np.concatenate([raw, np.zeros(3, np.uint8)])
            cp, good = np.where(n == 1, long & 31, np.where(n == 2, long & 15, long & 7)).astype(np.int64), long < 0xF5
            for k in (1, 2, 3):
                more = n >= k
                b = padded[high + k]
                good &= ~more | (b & 0xC0 == 0x80)
                cp = np.where(more, cp << 6 | b & 63, cp)
            good &= cp < 0x110000
            at, cls, n = high[good], table[cp[good]], n[good]
            out[at] = cls
            for k in (1, 2, 3):
                out[at[n >= k] + k] = cls[n >= k]
        return out

    def edges(mask):
        """Where runs begin and where they have ended; the last byte is in none."""
        turn = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if mask[0]:
            turn = np.concatenate([[0], turn])
        return turn[0::2], turn[1::2]

    def borders(word):
        """Word borders: at which bytes, where they are, and how many there are up to each byte."""
        border = np.empty(len(word), bool)
        border[0], border[1:] = word[0], word[1:] != word[:-1]
        return border, np.flatnonzero(border), np.cumsum(border, dtype=np.int32)

    def spans(inside, found):
        """Matches of ``\\b[inside]+\\b``: in each run from its first word border to its last; ``found`` is what ``borders`` gives."""
        border, place, before = found
        start, end = edges(inside)
        first, last = before[start] - border[start], before[end] - 1
        has = last > first
        return place[first[has]], place[last[has]]

    def read(column, case_kept: bool = False):
        """``(raw, ends of texts, class bits, changed)``: bytes as written, or with the letters of ``lowered`` in lower case."""
        column = column.cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends, changed = ends - ends[0], False
        if not case_kept and raw.max(initial=0) >= 0xC4 and any(c.encode() in raw.tobytes() for c in lowered):
            texts = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            for c, low in lowered.items():
                texts = [t.replace(c.encode(), low.encode()) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            raw, changed = np.frombuffer(b"".join(texts), np.uint8), True
        return raw, ends, marked(raw), changed

    def tokens(column):
        """What ``read`` gives of the lower case, the kinds of bytes, word borders, and where tokens begin and end."""
        raw, ends, bits, changed = read(column)
        kind, found = kinds[raw], borders(bits & lower_bit > 0)
        return raw, ends, bits, changed, kind, found, *spans(kind & 7 > 0, found)
    return read, edges, borders, spans, kinds, tokens


def term_reader(classes):
    """Functions (terms, pieces) of an Arrow array of texts in lower case, each ended by a line feed: strings and the text of each, where terms are
    stretches of two letters, digits, marks or underscores and more, and pieces all that stands between white space. They travel with the tasks."""
    read, edges, *_ = text_reader(classes)
    term_bit, blank_bit, at_once = TERM_PART, BLANK, AT_ONCE

    def strings(raw, ends, mask, start, end):
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[mask].tobytes())])
        return found, np.searchsorted(ends, start, "right") - 1

    def by_slices(one):
        def run(column):
            values, rows = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)]
            for at in range(0, len(column), at_once):
                found, row = one(*read(column.slice(at, at_once), True)[:3])
                values.append(found)
                rows.append(row + at)
            return pa.concat_arrays(values), np.concatenate(rows)
        return run

    def terms(raw, ends, bits):
        mask = bits & term_bit > 0
        start, end = edges(mask)
        # A single character is no term; it has up to four bytes.
        few = np.flatnonzero(end - start <= 4)
        first = raw[start[few]]
        one = few[end[few] - start[few] == 1 + (first >= 0xC2) + (first >= 0xE0) + (first >= 0xF0)]
        for k in range(4):
            mask[(start[one] + k)[start[one] + k < end[one]]] = False
        start, end = np.delete(start, one), np.delete(end, one)
        return strings(raw, ends, mask, start, end)

    def pieces(raw, ends, bits):
        mask = bits & blank_bit == 0
        return strings(raw, ends, mask, *edges(mask))
    return by_slices(terms), by_slices(pieces)


def word_finder():
    """Functions (table, find): ``table`` of distinct words, which can be broadcast, and ``find`` of (table, bytes, where tokens begin, their sizes):
    the places of the tokens, in lower case, among the words, -1 where absent. Both carry all they need.

    Up to sixteen letters are two numbers that are compared whole, so no two words are taken for one; longer tokens are looked up as they are.
    """
    sixteen = 16
    first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    small = np.uint64(0x2020202020202020)

    def numbers(raw, start, size):
        """The letters of each token as two numbers, in lower case."""
        padded = np.zeros(-(-len(raw) // 8) * 8 + 32, np.uint8)
        padded[:len(raw)] = raw
        eight = padded.view("<u8")

        def at(where, n):
            word, bit = where >> 3, ((where & 7) << 3).astype(np.uint64)
            # Shifts go up to 63.
            upper = np.where(bit > 0, eight[word + 1] << (np.uint64(64) - bit & np.uint64(63)), np.uint64(0))
            return (eight[word] >> bit | upper | small) & masks[n]
        low, high = at(start, np.minimum(size, 8)), np.zeros(len(start), np.uint64)
        more = np.flatnonzero(size > 8)
        if len(more):
            high[more] = at(start[more] + 8, np.minimum(size[more] - 8, 8))
        return low, high

    def slots(low, high, log):
        h = (low ^ high * first) * second
        return ((h ^ h >> np.uint64(29)) * first >> np.uint64(64 - log)).astype(np.int64)

    def table(words: list[str]):
        # Nothing else can be a token.
        token = re.compile("[a-z']+")
        short, long = [], {}
        for i, w in enumerate(words):
            if token.fullmatch(w):
                if len(w) <= sixteen:
                    short.append(i)
                else:
                    long[w] = i
        log = max(4, (4 * len(short)).bit_length())
        held = np.full(1 << log, -1, np.int32)
        low, high = np.zeros(len(words) + 1, np.uint64), np.zeros(len(words) + 1, np.uint64)
        places, sizes = np.array(short, np.int64), np.array([len(words[i]) for i in short], np.int64)
        low[places], high[places] = numbers(np.frombuffer("".join([words[i] for i in short]).encode(), np.uint8), np.cumsum(sizes) - sizes, sizes)
        slot = slots(low[places], high[places], log)
        while len(places):
            free = held[slot] < 0
            held[slot[free]] = places[free]
            left = held[slot] != places
            places, slot = places[left], slot[left] + 1 & len(held) - 1
        return log, held, low, high, long

    def find(made, raw, start, size):
        log, held, low_key, high_key, long = made
        low, high = numbers(raw, start, size)
        slot = slots(low, high, log)
        got = held[slot]
        same = (got >= 0) & (low_key[got] == low) & (high_key[got] == high)
        out = np.where(same, got, -1)
        left = np.flatnonzero((got >= 0) & ~same)
        while len(left):
            slot[left] = slot[left] + 1 & len(held) - 1
            got = held[slot[left]]
            same = (got >= 0) & (low_key[got] == low[left]) & (high_key[got] == high[left])
            out[left[same]] = got[same]
            left = left[(got >= 0) & ~same]
        for i in np.flatnonzero(size > sixteen).tolist():
            out[i] = long.get(raw[start[i]:start[i] + size[i]].tobytes().lower().decode(), -1)
        return out
    return table, find


def scanner(classes, vocabularies: dict[str, list[str]], wanted: list[str] | None = None, lexicon=None):
    """Function from an Arrow array of texts, each ended by a line feed, to their counts, those of ``wanted`` or all.

    ``lexicon`` is a broadcast ``(table, valence, times, flags)``: a table of ``word_finder``, and for each of its words the valence, how many tokens
    one counts for, and whether it is in each vocabulary by name. Then sums of ``valence`` are given too.
    """
    piece, find = PIECE, word_finder()[1]
    known = {n: [w for w in dict.fromkeys(ws) if w and all(c == "'" or "a" <= c <= "z" for c in w)] for n, ws in vocabularies.items()}
    word_bit, blank_bit, lower_bit = WORD, BLANK, LOWER_WORD
    read, edges, borders, spans, kinds, tokens = text_reader(classes)
    has = (lambda *names: True) if wanted is None else (lambda *names: any(n in wanted for n in names))

    def code(letters):
        """Numbers of words of one size from their letters, a column each; five bits a letter."""
        return sum(np.where(c == 39, 27, c & 31).astype(np.int64) << 5 * k for k, c in enumerate(letters))

    # Letters of the listed words by size.
    tables = {name: {} for name in known}
    for name, ws in known.items():
        for w in ws:
            tables[name].setdefault(len(w), []).append(np.frombuffer(w.encode(), np.uint8))
    sizes = sorted({size for by_size in tables.values() for size in by_size})

    def scan(column) -> dict[str, np.ndarray]:
        def per(at, ends):
            return np.diff(np.searchsorted(at, ends))

        # On lower case: tokens, listed words, vowels.
        raw, ends, bits, changed, kind, border, start, end = tokens(column)
        size = end - start
        out = {"n_tokens": per(start, ends)}
        if lexicon is not None:
            table, valence, times, flags = lexicon.value
            text, place = np.repeat(np.arange(len(ends) - 1), out["n_tokens"]), find(table, raw, start, size)
            # The last of the values stands for words that are not there.
            out["valence"] = np.bincount(text, valence[place], len(ends) - 1)
            if times is not None:
                out["n_tokens"] = np.bincount(text, times[place], len(ends) - 1).astype(np.int64)
            for name, inside in flags.items():
                hit = np.flatnonzero(inside[place])
                out[name] = np.bincount(text[hit], None if times is None else times[place[hit]], len(ends) - 1).astype(np.int64)
        else:
            hits = {name: [] for name in tables}
            for n in sizes:
                at = start[size == n]
                if n <= piece:
                    number = code([raw[at + k] for k in range(n)])
                for name, by_size in tables.items():
                    for w in by_size.get(n, ()):
                        same = number == code(w) if n <= piece else np.logical_and.reduce([(raw[at + k] == c) | ((raw[at + k] | 32 == c) & (c != 39)) for k, c in enumerate(w)])
                        hits[name].append(at[same])
            for name, found in hits.items():
                out[name] = per(np.sort(np.concatenate([*found, np.zeros(0, np.int64)])), ends)
        if has("n_syllables"):
            out["n_syllables"] = per(edges(kind & 8 > 0)[0], ends)
        # On the text as written.
        if changed:
            raw, ends, bits, _ = read(column, True)
            kind = kinds[raw]
        if has("n_words", "n_caps", "n_case") and (changed or (bits & word_bit != (bits & lower_bit) // (lower_bit // word_bit)).any()):
            border = borders(bits & word_bit > 0)
            if has("n_words", "n_caps"):
                start, end = spans(kind & 7 > 0, border)
        if has("n_words", "n_caps"):
            out["n_words"] = per(start, ends)
            # Most words have a small letter at one of their ends.
            few = (end - start >= 2) & (kind[start] & 1 == 0) & (kind[end - 1] & 1 == 0)
            start, end = start[few], end[few]
            small, large = (np.add.reduceat(kind & bit > 0, np.column_stack([start, end]).ravel(), dtype=np.int64)[::2] if len(start) else start for bit in (1, 2))
            out["n_caps"] = per(start[(small == 0) & (large > 0)], ends)
        if has("n_case"):
            out["n_case"] = per(spans(kind & 5 > 0, border)[0], ends)
        blank = bits & blank_bit > 0
        if has("n_blank"):
            out["n_blank"] = per(edges(~blank)[0], ends)
        if has("n_ellip"):
            dots = edges(raw == 46)
            out["n_ellip"] = per(dots[0][dots[1] - dots[0] >= 3], ends)
        if has("n_excl", "n_ques"):
            out["n_excl"], out["n_ques"] = per(np.flatnonzero(raw == 33), ends), per(np.flatnonzero(raw == 63), ends)
        if has("n_sentences"):
            # A sentence is a stretch after a mark or the begin of a text with a character that is no blank.
            stop = kind & 16 > 0
            stop[ends[1:] - 1] = True
            last = np.flatnonzero(stop)
            at = np.concatenate([[0], last[:-1] + 1])
            # Blanks at the begin of a stretch are few; where they are not, the next character that is none is looked up.
            for _ in range(4):
                at = at + (blank[at] & ~stop[at])
            if (blank[at] & ~stop[at]).any():
                seen = np.flatnonzero(stop | ~blank)
                at = seen[np.searchsorted(seen, at)]
            out["n_sentences"] = per(last[at < last], ends)
        return out
    return scan


def text_counts(posts: DataFrame, keep: list[str], text, counts: list[str], vocabularies: dict[str, list[str]] | None = None, lexicon=None) -> DataFrame:
    """``keep`` and the numbers ``counts`` of each row's ``text`` (no null): those of ``scanner`` or names of ``vocabularies``."""
    spark, at_once = posts.sparkSession, AT_ONCE
    scan = scanner(spark.sparkContext.broadcast(char_classes(spark)), vocabularies or {}, counts, lexicon)
    rows = posts.select(*keep, F.concat(text, F.lit("\n")).alias("_text"))
    kinds = {c: ("double", np.float64) if c == "valence" else ("int", np.int32) for c in counts}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{c} {kinds[c][0]}" for c in counts])

    def run(batches):
        for batch in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once)):
            got = scan(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(got[c].astype(kinds[c][1])) for c in counts]], names=[*keep, *counts])
    return rows.mapInArrow(run, schema)

"""License scans with a generalised suffix automaton over the words of license templates.

The automaton holds every run of words of every template. Streaming a file through it gives, at each word, the length of
the longest run that ends there and stands in some template (matching statistics). Maximal matches are chained in file and
template order into covered template spans. The phrases of the base labels are templates too: each of their places is a
word where the current state has the phrase on its chain of suffix links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, query, table

# Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Wording of well-known license notices, by label.
TEMPLATES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                 "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-text", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
                    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                 "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                 "conditions are met"),
    ("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                 "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("gpl-work", "This work is licensed under the GNU General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("mit-line", "Released under the MIT License"),
]
#: Lower-case letters, digits and bytes from 0x80 stay; A-Z become lower case; all others part words.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """A suffix automaton of several word sequences; as many states as twice their words at most."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: For each state, an end position in every sequence that its runs stand in.
        self.ends: list[dict[int, int]] = [{}]
        for number, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, at)
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            for number, at in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, at)

    def _new(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, origin: int, word: int) -> int:
        """The state of ``origin``'s longest run with ``word`` after it, split from a larger one if need be."""
        target = self.next[origin][word]
        if self.size[target] == self.size[origin] + 1:
            return target
        clone = self._new(self.size[origin] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while origin >= 0 and self.next[origin].get(word) == target:
            self.next[origin][word] = clone
            origin = self.link[origin]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state, origin = self._new(self.size[last] + 1, 0, {}), last
        while origin >= 0 and word not in self.next[origin]:
            self.next[origin][word] = state
            origin = self.link[origin]
        if origin >= 0:
            self.link[state] = self._split(origin, word)
        return state

    def find(self, seq: list[int]) -> int:
        state = 0
        for word in seq:
            state = self.next[state][word]
        return state

    def statistics(self, seq):
        """State and match length after each word."""
        state = length = 0
        for word in seq:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                length = 0
            yield state, length


class Scanner:
    def __init__(self, phrases, templates, min_run: int, max_gap: int, min_share: float):
        self.phrases, self.templates = phrases, [*phrases, *((t, label) for label, t in templates)]
        self.min_run, self.max_gap, self.min_share = min_run, max_gap, min_share
        texts = [words(t.encode()) for t, _ in self.templates]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        seqs = [[self.ids[w] for w in t] for t in texts]
        self.sizes = [len(s) for s in seqs]
        self.auto = Automaton(seqs)
        base = {self.auto.find(seqs[i]): i for i in range(len(phrases)) if len(seqs[i]) > 1}
        #: Phrases of one word need no run; every place of the word is one.
        self.alone = [(seqs[i][0], i) for i in range(len(phrases)) if len(seqs[i]) == 1]
        self.found = []
        for state in range(len(self.auto.size)):
            on, s = [], state
            while s > 0:
                if s in base:
                    on.append(base[s])
                s = self.auto.link[s]
            self.found.append(on)
        n = len(self.ids)
        self.pair = np.zeros((n + 1, n + 1), bool)
        self.sure = np.zeros((n + 1, n + 1), bool)
        for i, s in enumerate(seqs):
            for a, b in zip(s, s[1:]):
                self.pair[a, b] = True
                if i < len(phrases):
                    self.sure[a, b] = True

    def scan(self, text: bytes):
        """Number of words, places of phrases, and for each template its best chain: (covered words, spans)."""
        ws = words(text)
        ids = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int32, len(ws))
        matches, places = [], [(at, p) for word, p in self.alone for at in np.flatnonzero(ids == word).tolist()]
        ok = self.pair[ids[:-1], ids[1:]]
        if ok.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
            sure = np.concatenate([[0], np.cumsum(self.sure[ids[:-1], ids[1:]])])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a + 1 < self.min_run and sure[b] == sure[a]:
                    continue
                run, last = ids[a:b + 1].tolist(), None
                for at, (state, length) in enumerate(self.auto.statistics(run), a):
                    for p in self.found[state]:
                        if length >= self.sizes[p]:
                            places.append((at - self.sizes[p] + 1, p))
                    if last and length <= last[1]:
                        matches.append((at - last[1], *last))
                    last = state, length
                matches.append((b + 1 - last[1], *last))
        return len(ws), places, self.chains(matches)

    def chains(self, matches):
        """Greedy colinear chains of the matches: template number -> (covered words, [(first word, words)])."""
        best: dict[int, tuple[int, list]] = {}
        open_: dict[int, list] = {}
        for start, state, length in matches:
            if length < 2:
                continue
            for t, end in self.auto.ends[state].items():
                if length < min(self.min_run, self.sizes[t]):
                    continue
                c = open_.get(t)
                if c and start - c[1] <= self.max_gap and end - length >= c[0] - 1 and start >= c[1]:
                    c[0], c[1], c[2] = end, start + length, c[2] + length
                    c[3].append((start, length))
                else:
                    c = open_[t] = [end, start + length, length, [(start, length)]]
                if c[2] > best.get(t, (0,))[0]:
                    best[t] = c[2], list(c[3])
        return best

    def row(self, text: bytes):
        n, places, best = self.scan(text)
        share = {t: covered / self.sizes[t] for t, (covered, _) in best.items()}
        base = sorted({self.phrases[p][1] for _, p in places})
        more = {self.templates[t][1] for t, s in share.items() if s >= self.min_share and t >= len(self.phrases)}
        starts = [a for a, _ in places]
        spans = sorted({s for t, (_, got) in best.items() if share[t] >= self.min_share for s in got})
        return (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *more})),
                1.0 if base else min(1.0, max(share.values(), default=0.0)), ";".join(f"{a}+{k}" for a, k in spans))


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
          ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, min_run: int = 4,
                  max_gap: int = 12, min_share: float = 0.6) -> DataFrame:
    """One row for each row of ``docs``: its id and ``n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists the covered spans as ``first word+words``; ``score`` is 1 where a phrase stands, else the largest
    covered share of a template. A null text is empty: no words, labels '' and score 0. Ties between templates keep all
    labels. Repeated rows give repeated results, an empty table none. Other columns are dropped. Texts are read whole;
    the automaton is as large as the templates and is all that is sent to tasks.
    """
    def run(batches):
        scanner = Scanner(phrases, templates, min_run, max_gap, min_share)
        for batch in batches:
            rows = list(zip(*map(scanner.row, byte_list(batch.column(1))))) or [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, (_, t) in zip(rows, FIELDS))], names=["doc_id", *(n for n, _ in FIELDS)])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                  "score double, spans string")


@query("op7_license_automaton")
def op7(spark, sf):
    """License phrases and template spans of every document."""
    return scan_licenses(table(spark, sf, "documents"))

"""Licence scanning with one generalised suffix automaton of licence tokens.

The words of all templates and base phrases are put into one suffix automaton.
A document streams through it once: at each word the automaton gives the longest
string of template words that ends there (matching statistics).  Long maximal
matches are chained, in template order, into covered spans of a template, by
dynamic programming over the matches within reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import word_tokens

#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Texts and notices of public licences, by label; each paragraph is a template of its own.
TEMPLATES = {
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "cc-by-nc": ("Licensed under CC BY NC 4.0",),
}
#: Words that a match has at least to enter a chain, words of the text that a chain may skip, and the part of a template to be covered.
LEAST_MATCH, GAP, LEAST_COVER = 3, 50, 0.7


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the places of each state's strings."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[set[tuple[int, int]]] = [set()]
        for k, text in enumerate(texts):
            last = 0
            for i, c in enumerate(text):
                last = self._extend(last, c, places)
                places[last].add((k, i))
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                places[self.link[v]] |= places[v]
        self.places = [sorted(p) for p in places]

    def _state(self, length: int, nxt: dict[int, int], link: int, places: list) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        places.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int, places: list) -> int:
        """The part of q whose strings are p's with c; q itself if it has no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], places)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, places: list) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c], places)
        new, p = self._state(self.length[last] + 1, {}, 0, places), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c], places)
        return new


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.words: dict[bytes, int] = {}
        numbers = lambda s: [self.words.setdefault(w, len(self.words) + 1) for w in word_tokens(s.encode())]
        self.labels = [label for label, texts in templates.items() for _ in texts]
        texts = [numbers(t) for many in templates.values() for t in many]
        self.sizes = [len(t) for t in texts]
        phrases = [(numbers(p), label) for p, label in PHRASES.items()]
        self.sam = SuffixAutomaton(texts + [p for p, _ in phrases])
        at: dict[int, list[tuple[int, str]]] = {}
        for p, label in phrases:
            v = 0
            for c in p:
                v = self.sam.next[v][c]
            at.setdefault(v, []).append((len(p), label))
        # a state ends with the phrases of all states that its suffix links lead to
        self.ends: list[list[tuple[int, str]]] = []
        for v in range(len(self.sam.length)):
            found, u = [], v
            while u > 0:
                found += at.get(u, [])
                u = self.sam.link[u]
            self.ends.append(found)

    def scan(self, text: str | None):
        """(n_words, base places (start, label), chains (label, start, end, cover)) of a whole text."""
        words, get = word_tokens((text or "").encode()), self.words.get
        nxt, link, length, ends = self.sam.next, self.sam.link, self.sam.length, self.ends
        state = size = 0
        base, matches = [], []
        for i, w in enumerate(words):
            c = get(w, 0)
            if not c:
                if size >= LEAST_MATCH:
                    matches.append((i - size, size, state))
                state = size = 0
                continue
            if c not in nxt[state]:
                if size >= LEAST_MATCH:
                    matches.append((i - size, size, state))
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
                for n, label in ends[state]:
                    if n <= size:
                        base.append((i - n + 1, label))
        if size >= LEAST_MATCH:
            matches.append((len(words) - size, size, state))
        return len(words), base, self._chains(matches)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The best chains of each template that don't overlap in the text: label, start, end, covered part.

        A chain takes matches that go on in the text and in the template, with at
        most ``GAP`` words of text between them; of all chains that end in a match
        at one of its places the one that covers most is kept, so a stray fragment
        breaks nothing.
        """
        ends: dict[int, list[tuple[int, int, int, int]]] = {}  # template: chains as covered, start, end, its last word
        for start, n, state in matches:
            for k, last in self.sam.places[state]:
                if k < len(self.sizes):
                    chains = ends.setdefault(k, [])
                    best = (n, start, start + n, last)
                    for covered, first, end, at in reversed(chains):
                        if start - end > GAP:
                            break
                        new = min(n, last - at, start + n - end)
                        if new > 0 and covered + new > best[0]:
                            best = (covered + new, first, start + n, last)
                    chains.append(best)
        out = []
        for k, chains in ends.items():
            taken: list[tuple[int, int]] = []
            for covered, start, end, _ in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
                if covered < LEAST_COVER * self.sizes[k]:
                    break
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append((self.labels[k], start, end, covered / self.sizes[k]))
        return sorted(out, key=lambda x: (x[1], x[0], x[2]))


_scanner: list[Scanner] = []
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_row(text: str | None) -> tuple:
    if not _scanner:
        _scanner.append(Scanner())
    n, base, chains = _scanner[0].scan(text)
    starts, labels = [s for s, _ in base], {label for _, label in base}
    return (
        n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {c[0] for c in chains})), max([0.5 if base else 0.0, *[c[3] for c in chains]]),
        ",".join(f"{label}:{a}:{b}" for label, a, b, _ in chains),
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        cols = list(zip(*[license_row(t.as_py()) for t in batch.column(1)], strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of base phrases, labels, score and covered template spans.

    A null text is empty and has no words; a null id stays null; repeated rows
    are scanned alike; other columns are not looked at; no rows give no rows.
    The score is the largest covered part of a template, 0.5 at least where a
    base phrase stands, 0 without any.  Spans are words, the end exclusive.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, _SCHEMA)

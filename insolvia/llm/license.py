"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template, and the base phrases. A text is streamed
through it word by word: at each word the automaton gives the longest run ending there that occurs
in some template (the matching statistics). Runs of at least MIN_RUN words that cannot be extended
are anchors, at every place of the template where the run stands; anchors of one template that follow
each other in the text and in the template, with gaps of at most MAX_GAP words, are chained into spans by
dynamic programming. A template with a span that covers at least `coverage` of its words gives its label;
a label may have several templates (the paragraphs of its licence), so a file that holds a licence from
its second paragraph on is found. A base phrase gives its label wherever its words stand.

Words are the runs of alphanumeric bytes (every non-ASCII byte counts) of the lowered text.
The templates are a fixed short list given as a parameter, so the automaton is small.

Defined cases: null and empty texts have no words, labels "" and score 0; equal labels are named once
and sorted; repeated rows get equal answers; only the two named columns are read.
"""
from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, chunked, row_id, shown_id, text_bytes

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Passages of public licence texts, by label. A passage that two licences share word for word is left out.
# The opening passage:
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "zlib": "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}
# Later paragraphs:
LATER = {
    "mit": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    ],
    "bsd": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
    ],
    "isc": [
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    ],
    "apache": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ],
    "unlicense": [
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
}

MIN_RUN = 4
MAX_GAP = 8
COVERAGE = 0.6


def best_chains(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (first word, last word, words covered) of one template's anchors (first, last in the text; first, last in the template).

    Each anchor takes the predecessor that covers most; only those that end within MAX_GAP of it can be one. Of
    the chains, one for each anchor that starts one, the best that do not overlap in the text stay.
    """
    found = sorted(found, key=lambda x: (x[1], x[3]))
    value, root = [0] * len(found), list(range(len(found)))
    ends = [x[1] for x in found]
    best: dict[int, int] = {}
    for i, (first, last, a, b) in enumerate(found):
        value[i] = last - first + 1
        for j in range(bisect_left(ends, first - MAX_GAP), bisect_left(ends, last)):
            over, until = ends[j], found[j][3]
            if until < b and a - until <= MAX_GAP:
                grown = value[j] + max(0, min(last - max(first, over + 1), b - max(a, until + 1)) + 1)
                if grown > value[i]:
                    value[i], root[i] = grown, root[j]
        if value[i] > value[best.setdefault(root[i], i)]:
            best[root[i]] = i
    taken: list[tuple[int, int, int]] = []
    for start, end in sorted(best.items(), key=lambda x: (-value[x[1]], x[1])):
        span = (found[start][0], found[end][1], value[end])
        at = bisect_left(taken, span)
        if (at == 0 or taken[at - 1][1] < span[0]) and (at == len(taken) or span[1] < taken[at][0]):
            taken.insert(at, span)
    return taken


class LicenseAutomaton:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str | Sequence[str]]):
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}  # state: (template, place) of the beginnings that end in it
        self.phrases = [(p.encode().translate(ALNUM).split(), label) for p, label in sorted(phrases.items())]
        self.templates = [
            (text.encode().translate(ALNUM).split(), label) for label, texts in sorted(templates.items()) for text in ([texts] if isinstance(texts, str) else texts)
        ]
        for k, (words, _) in enumerate([*self.templates, *self.phrases]):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.numbers.setdefault(word, len(self.numbers) + 1))
                if k < len(self.templates):
                    own.setdefault(last, []).append((k, at))
        order = sorted(range(1, len(self.size)), key=lambda s: -self.size[s])
        # All places of a state are its own and those of the states linked to it: a slice of the tree's depth-first order.
        children: list[list[int]] = [[] for _ in self.size]
        for s in order:
            children[self.link[s]].append(s)
        self.places: list[tuple[int, int]] = []
        self.slice: list[tuple[int, int]] = [(0, 0)] * len(self.size)
        todo = [(0, -1)]
        while todo:
            s, entered = todo.pop()
            if entered >= 0:
                self.slice[s] = (entered, len(self.places))
                continue
            todo.append((s, len(self.places)))
            self.places.extend(own.get(s, ()))
            todo.extend((c, -1) for c in children[s])
        # For each state the phrases that are a suffix of its runs.
        at_state: dict[int, list[int]] = {}
        for k, (words, _) in enumerate(self.phrases):
            s = 0
            for w in words:
                s = self.next[s][self.numbers[w]]
            at_state.setdefault(s, []).append(k)
        self.closed: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)
        for s in reversed(order):
            here = tuple((len(self.phrases[k][0]), k) for k in at_state.get(s, ()))
            self.closed[s] = here + self.closed[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        """The state of the run grown by one word; equal runs of several templates share states."""
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._split(last, q, c)
        new = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        copy = len(self.size)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], dict[str, float], list[tuple[str, int, int, float]]]:
        """Number of words; (first word, phrase) of every base place; coverage by label; chained spans (label, first, last word, coverage)."""
        words = text.translate(ALNUM).split()
        ids = list(map(self.numbers.get, words))
        nxt, link, size, closed = self.next, self.link, self.size, self.closed
        base, anchors = [], []
        state = length = 0
        for at, c in enumerate(ids):
            if c is None:
                if length >= MIN_RUN:
                    anchors.append((at - 1, length, state))
                state = length = 0
                continue
            before, grown = (state, length), length
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            else:
                state = length = 0
            if grown >= MIN_RUN and length != grown + 1:
                anchors.append((at - 1, grown, before[0]))
            if closed[state]:
                base.extend((at - n + 1, k) for n, k in closed[state] if n <= length)
        if length >= MIN_RUN:
            anchors.append((len(ids) - 1, length, state))
        spans = self._chains(anchors) if anchors else []
        covered: dict[str, float] = {}
        for label, _, _, share in spans:
            covered[label] = max(covered.get(label, 0.0), share)
        return len(words), base, covered, spans

    def places_of(self, state: int) -> list[tuple[int, int]]:
        """(template, place of the last word) of every occurrence of the state's runs."""
        low, high = self.slice[state]
        return self.places[low:high]

    def _chains(self, anchors):
        """Best chains of anchors of each template: text and template places both go forward, with short gaps."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, length, state in anchors:
            for k, at in self.places_of(state):
                by_template.setdefault(k, []).append((end - length + 1, end, at - length + 1, at))
        spans = [
            (self.templates[k][1], first, last, min(1.0, words / len(self.templates[k][0])))
            for k, found in by_template.items() for first, last, words in best_chains(found)
        ]
        return sorted(spans, key=lambda s: (s[1], s[0], s[2], s[3]))


@lru_cache(maxsize=2)
def _automaton(blob: bytes) -> LicenseAutomaton:
    return LicenseAutomaton(*pickle.loads(blob))


def scan_licenses(docs: DataFrame, ident: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str | Sequence[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    blob = pickle.dumps((phrases or PHRASES, templates or {label: [text, *LATER.get(label, ())] for label, text in TEMPLATES.items()}))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span),
    ])

    def run(batches):
        automaton = _automaton(blob)
        for batch in chunked(batches, "text"):
            out = [[] for _ in range(8)]
            for raw in text_bytes(batch.column("text")):
                total, base, covered, spans = automaton.scan(raw)
                starts = [at for at, _ in base]
                named = sorted({automaton.phrases[k][1] for _, k in base})
                labels = sorted({*named, *(label for label, share in covered.items() if share >= coverage)})
                score = 1.0 if named else max(covered.values(), default=0.0)
                row = (total, len(base), min(starts, default=None), max(starts, default=None), ",".join(named), ",".join(labels), score,
                       [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans])
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, schema.types[1:]))], schema=schema)

    rows = docs.select(row_id(ident).alias("id"), F.col(text).cast("string").alias("text"))
    done = rows.mapInArrow(
        run,
        "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>",
    )
    return done.withColumn("id", shown_id(F.col("id"))).withColumnRenamed("id", "doc_id")

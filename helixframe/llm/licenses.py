"""Licence scans with a generalised suffix automaton of template words.

The automaton holds every substring of every template. A text is streamed through it word by
word, which gives the matching statistic of each position: the length of the longest match that
ends there. Matches of ``min_match`` words or more become seeds; per template the seeds are
chained in order, and the chain covers spans of the template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.nested import identifier

MIN_MATCH, MIN_COVER = 4, 0.5
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Short notices by which works name their licence.
NOTICES: dict[str, str] = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-work": "This work is licensed under the GNU General Public License version 3",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-short": "Released under the MIT license",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "proprietary": "All rights reserved",
}


@lru_cache(maxsize=1)
def default_templates() -> dict[str, str]:
    """The notices, and the whole licence texts of the folder ``licence_texts`` by their lower-case names."""
    texts = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return NOTICES | {t.stem.lower(): t.read_text() for t in texts}


_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased ASCII alphanumeric and non-ASCII runs of UTF-8 ``text``."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; ``first`` is one (template, end) of a state."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for template, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((template, end))
        # a state ends wherever the states that link to it end
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, length = to, length + 1
            else:
                state = length = 0
            yield state, length


@dataclass
class Scan:
    n_words: int
    n_base: int
    first: int | None
    last: int | None
    base: list[str]
    covered: dict[str, float]
    spans: list[tuple[str, int, int, int]]  # label, first word in the text, first word in the template, words


def chain(seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of seeds (start in text, start in template, words) a chain ascending in both, heaviest by words covered."""
    seeds = sorted(set(seeds))
    ends: list[int] = []  # ascending template ends with rising weight
    best: list[tuple[int, int]] = []  # (weight, seed)
    back, weight = [-1] * len(seeds), [0] * len(seeds)
    waiting: list[tuple[int, int]] = []  # (text end, seed): open until the text passes their end
    import heapq

    for i, (at, own, n) in enumerate(seeds):
        while waiting and waiting[0][0] <= at:
            _, j = heapq.heappop(waiting)
            end = seeds[j][1] + seeds[j][2]
            k = bisect_left(ends, end + 1)
            if k and best[k - 1][0] >= weight[j]:
                continue
            while k < len(ends) and best[k][0] <= weight[j]:
                del ends[k], best[k]
            if k and ends[k - 1] == end:
                k -= 1
                del ends[k], best[k]
            ends.insert(k, end)
            best.insert(k, (weight[j], j))
        k = bisect_left(ends, own + 1)
        weight[i], back[i] = n + (best[k - 1][0] if k else 0), best[k - 1][1] if k else -1
        heapq.heappush(waiting, (at + n, i))
    i, out = max(range(len(seeds)), key=weight.__getitem__, default=-1), []
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


class Scanner:
    """Phrases and template spans of texts."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH) -> None:
        self.templates = {k: words_of(v.encode()) for k, v in (default_templates() if templates is None else templates).items()}
        self.labels, self.min_match = list(self.templates), min_match
        self.phrases = {k: v.encode().split() for k, v in (PHRASES if phrases is None else phrases).items()}
        vocabulary: dict[bytes, int] = {}
        for run in [*self.templates.values(), *self.phrases.values()]:
            for w in run:
                vocabulary.setdefault(w, len(vocabulary) + 1)
        self.vocabulary = vocabulary
        self.runs = [[vocabulary[w] for w in run] for run in self.templates.values()]
        self.automaton = SuffixAutomaton(self.runs)
        self.rare = {k: [vocabulary[w] for w in v] for k, v in self.phrases.items()}
        self.shortest = min([min_match, *(len(t) for t in self.templates.values())])
        #: a match as long as a whole short template counts too
        self.whole = {i: len(t) for i, t in enumerate(self.templates.values())}

    def scan(self, text: bytes) -> Scan:
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        places: dict[str, np.ndarray] = {}
        for label, run in self.rare.items():
            at = np.flatnonzero(ids[len(run) - 1 :] == run[-1]) if len(ids) >= len(run) else np.zeros(0, np.int64)
            for j, w in enumerate(run[:-1]):
                at = at[ids[at + j] == w]
            if len(at):
                places[label] = at
        found: dict[int, list[tuple[int, int, int]]] = {}
        # only runs of template words can hold a long match
        inside = np.flatnonzero(ids)
        if len(inside) >= self.shortest:
            cuts = np.flatnonzero(np.diff(inside) > 1) + 1
            starts, stops = inside[np.concatenate([[0], cuts])], inside[np.concatenate([cuts - 1, [len(inside) - 1]])] + 1
            for a, b in zip(*(x[stops - starts >= self.shortest].tolist() for x in (starts, stops)), strict=True):
                self._seeds(ids[a:b].tolist(), a, found)
        covered, spans = {}, []
        for template, seeds in found.items():
            linked = chain(seeds)
            mask = np.zeros(self.whole[template], bool)
            for _, own, n in linked:
                mask[own : own + n] = True
            label = self.labels[template]
            covered[label] = float(mask.mean())
            spans += [(label, at, own, n) for at, own, n in linked]
        all_ = np.concatenate(list(places.values())) if places else None
        return Scan(
            len(words), 0 if all_ is None else len(all_), None if all_ is None else int(all_.min()), None if all_ is None else int(all_.max()), sorted(places), covered, spans
        )

    def _seeds(self, run: list[int], start: int, found: dict[int, list[tuple[int, int, int]]]) -> None:
        """Per template the matches of a run that grow neither way in it; shorter ones than the longest are suffix links away."""
        ends, link, size = self.automaton.ends, self.automaton.link, self.automaton.length
        for i, (state, length) in enumerate(self.automaton.statistics(run)):
            after = run[i + 1] if i + 1 < len(run) else 0
            longer: set[tuple[int, int]] = set()
            while state > 0 and length >= self.shortest:
                for template, end in ends[state] - longer:
                    grows = end + 1 < self.whole[template] and self.runs[template][end + 1] == after
                    if not grows and length >= min(self.min_match, self.whole[template]):
                        found.setdefault(template, []).append((start + i - length + 1, end - length + 1, length))
                longer, state = ends[state], link[state]
                length = size[state]


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], min_match: int) -> Scanner:
    """One automaton a worker process."""
    return Scanner(dict(templates), min_match=min_match)


def license_scan(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document the base phrases, the labels of covered templates, the covered spans and a score.

    A template labels a text when a chain of matches of ``min_match`` words or more (or of the whole template
    where that is shorter) covers ``min_cover`` of it. The score is the largest covered
    share, and 1 where a base phrase stands. Null or empty texts have no words and score 0.
    Repeated rows give repeated results; identifiers keep their type, nulls too; further columns are not
    carried; empty tables give none. ``templates``: label to text, by default ``default_templates``.
    """
    kind, arrow_kind = identifier(docs, ident)
    given = default_templates() if templates is None else templates
    kinds = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    spans = "array<struct<label:string,text_word:long,template_word:long,words:long>>"
    item = pa.struct([("label", pa.string()), ("text_word", pa.int64()), ("template_word", pa.int64()), ("words", pa.int64())])
    arrow = [arrow_kind] + [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(item)]
    names = [k.split()[0] for k in kinds.split(", ")] + ["spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(tuple(given.items()), min_match)
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary()):
                s = scanner.scan(t.as_py() or b"")
                own = [k for k, v in s.covered.items() if v >= min_cover]
                score = max([1.0 if s.n_base else 0.0, *s.covered.values()])
                labels = ",".join(sorted({*s.base, *own}))
                rows.append((s.n_words, s.n_base, s.first, s.last, ",".join(s.base), labels, score, [dict(zip(("label", "text_word", "template_word", "words"), x, strict=True)) for x in s.spans]))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, arrow[1:], strict=True))], names=names)

    return docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{kinds}, spans {spans}")


def license_report(docs: DataFrame) -> DataFrame:
    """The scan of every row without its spans; awkward rows as in ``license_scan``."""
    return license_scan(docs).drop("spans")

"""Licence scans with a generalised suffix automaton of licence texts.

The automaton holds every run of tokens of all templates. Streaming a file's tokens through it gives, at each place, the longest
match that ends there (matching statistics); maximal long matches are then chained, in order in text and template, into covered
spans. A token that no template has resets the match, so only runs of known tokens are walked; finding those is vectorised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopyq.llm import kernels as K
from canopyq.llm.rows import in_small_batches

# Public licence notices and the phrases and labels of the base rule, as text.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit-text": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    """Words of a text once A-Z are lower-cased."""
    return _WORD.findall(text.translate(_LOWER))


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences.

    ``ends[state]`` maps each sequence that contains the state's strings to the place where they first end in it.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.link, self.length, self.next = [-1], [0], [{}]
        self.ends: list[dict[int, int]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, place)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            parent = self.ends[self.link[state]]
            for k, place in self.ends[state].items():
                parent[k] = min(parent.get(k, place), place)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        state, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return state

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """For each place: the state and length of the longest known run that ends there."""
        state, length, found = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            found.append((state, length))
        return found


@dataclass(frozen=True)
class ScanRules:
    """A match counts from ``least`` words; a chain bridges up to ``gap`` words; a label needs ``share`` of its template."""

    least: int = 4
    gap: int = 8
    share: float = 0.6


class LicenceScanner:
    """Templates compiled for scanning chunks of documents."""

    def __init__(self, templates: dict[str, tuple[str, ...]], rules: ScanRules) -> None:
        self.rules = rules
        self.names = [n for n, texts in templates.items() for _ in texts]
        sequences = [words(t) for texts in templates.values() for t in texts]
        vocabulary = sorted({w for s in sequences for w in s} | {w for p in PHRASES for w in p.split()})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[number[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        hashes = self._hash(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrases = [([number[w] for w in p.split()], label) for p, label in PHRASES.items()]

    @staticmethod
    def _hash(vocabulary: list[str]) -> np.ndarray:
        data, offsets = K.string_parts(pa.array(vocabulary))
        return K.Prefix(data, K.FOLDED_VALUES).span(offsets[:-1], offsets[1:])

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary number of each word (-1 if no template has it), and the rows' offsets."""
        starts, ends, first = K.runs(K.ALNUM[data], offsets)
        h = K.Prefix(data, K.FOLDED_VALUES).span(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1), first

    def matches(self, tokens: list[int], shift: int) -> list[tuple[int, int, int, int]]:
        """Maximal matches of a run: template, place in text, place in template, length."""
        found, out = self.automaton.statistics(tokens), []
        for i, (state, length) in enumerate(found):
            if length >= self.rules.least and (i + 1 == len(found) or found[i + 1][1] <= length):
                out += [(k, shift + i + 1 - length, end + 1 - length, length) for k, end in self.automaton.ends[state].items()]
        return out

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains matches of a template that go on in text and template: label, first word, word after the last, covered share."""
        best: dict[tuple[str, int], tuple[str, int, int, float]] = {}
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for k, at, place, length in matches:
            by_template.setdefault(k, []).append((at, place, length))
        for k, mine in by_template.items():
            mine.sort()
            scores: list[int] = []
            back: list[int] = []
            for i, (at, place, length) in enumerate(mine):
                score, before = length, -1
                for j in range(i - 1, -1, -1):
                    a, p, n = mine[j]
                    if at - (a + n) > self.rules.gap:
                        if at - a > self.rules.gap + len(self.sequences[k]):
                            break
                        continue
                    over = max(0, a + n - at, p + n - place)
                    if a < at and p < place and over < length and scores[j] + length - over > score:
                        score, before = scores[j] + length - over, j
                scores.append(score)
                back.append(before)
            for i, (at, _, length) in enumerate(mine):
                share = scores[i] / len(self.sequences[k])
                if share >= self.rules.share:
                    first = i
                    while back[first] >= 0:
                        first = back[first]
                    key = (self.names[k], mine[first][0])
                    if key not in best or best[key][3] < share:
                        best[key] = (self.names[k], mine[first][0], at + length, min(1.0, share))
        return sorted(best.values())

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """A row of results for each document of a chunk."""
        number, first = self.numbers(data, offsets)
        n, rows = len(offsets) - 1, np.searchsorted(first[1:], np.arange(len(number)), "right")
        places, kinds = [], []
        for sequence, label in self.phrases:
            m = len(sequence)
            hit = np.ones(max(0, len(number) - m + 1), bool)
            for k, token in enumerate(sequence):
                hit &= number[k : len(number) - m + 1 + k] == token
            at = np.flatnonzero(hit)
            at = at[rows[at] == rows[at + m - 1]]
            places.append(at)
            kinds += [label] * len(at)
        place = np.concatenate(places)
        base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for at, kind in zip(place.tolist(), kinds, strict=True):
            base[rows[at]].append((at - int(first[rows[at]]), kind))
        spans: list[list[tuple[str, int, int, float]]] = [[] for _ in range(n)]
        known = number >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        long = stop - begin >= self.rules.least
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for b, e in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
            cuts = [b, *first[(first > b) & (first < e)].tolist(), e] if rows[b] != rows[e - 1] else [b, e]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x >= self.rules.least and (got := self.matches(number[x:y].tolist(), x - int(first[rows[x]]))):
                    found.setdefault(int(rows[x]), []).extend(got)
        for row, got in found.items():
            spans[row] = self.chains(got)
        out = []
        for i in range(n):
            labels = {k for _, k in base[i]}
            at = [p for p, _ in base[i]]
            score = max([s for *_, s in spans[i]], default=0.0)
            out.append((
                int(first[i + 1] - first[i]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans[i]})),
                score if spans[i] else 0.5 * bool(labels), [{"label": a, "first_word": b, "after_word": c, "share": d} for a, b, c, d in spans[i]],
            ))
        return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("after_word", pa.int64()), ("share", pa.float64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, rules: ScanRules = ScanRules(), text: str = "text") -> DataFrame:
    """Finds licence phrases and covered template spans in every whole text; one row for each row of the input.

    Null and empty texts have no word, no label and score 0. The score is the largest covered share of a template, or 0.5 where
    only a phrase stands. Repeated rows are scanned each by itself; other columns are never read; an empty table gives an empty result.
    """
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(chosen, rules)
        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(1))
            for a, b, part, at in K.chunks(data, offsets):
                columns = zip(*scanner.scan(part, at), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", *_NAMES])

    return in_small_batches(docs.select(docs["doc_id"].cast("long"), docs[text].cast("string"))).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first_word: long, after_word: long, share: double>>",
    )

"""Repetition coverage: characters inside duplicated word n-grams and lines.

Rolling hashes of several n-gram lengths are computed in numpy over whole chunks of
documents. A window of n words can only repeat where its first three words do, so
longer lengths look at those places alone. Nothing is shuffled; a document is judged by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopyq.llm import kernels as K
from canopyq.llm.rows import annotated, lists


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the shares of word characters inside duplicated n-grams, of duplicated lines and of characters in them.

    Words in duplicated n-grams are among the base rule's repeated words, so only limits well below its percentage can reject anything more.
    The share of lines has more room: a text of three lines that says one of them twice has a third, as some of good quality do.
    """

    min_words: int = 50
    max_repeat_words_percent: int = 50
    ngram_limits: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.28), (7, 0.26), (8, 0.24), (9, 0.22), (10, 0.20))
    max_dup_line_share: float = 0.35
    max_dup_line_chars: float = 0.30


_SYMBOLS = K.byte_class(*b"#*$%&|<>")

RESULTS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "dup_line_char_share": "double",
    "dup_ngram_char_share": "array<double>",
}


def _repeated(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice in a row."""
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts and verdicts for a chunk of documents."""
    n = len(offsets) - 1
    salt = K.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    member = K.NONSPACE[data]
    starts, ends, first = K.runs(member, offsets)
    words = np.diff(first)
    doc, _ = K.spread(words)
    chars = K.code_points(data)
    size = chars[ends] - chars[starts]
    prefix = K.Prefix(data, K.BYTE_VALUES)
    hashes = prefix.span(starts, ends)
    word_chars = K.row_sums(size, first)

    begin, stop, row = K.pieces(data == 10, offsets)
    filled = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)  # a word starts inside
    begin, stop, row = begin[filled], stop[filled], row[filled]
    line_key = prefix.span(begin, stop) ^ salt[row]
    order = np.argsort(line_key, kind="stable")
    later = order[1:][(line_key[order][1:] == line_key[order][:-1]) & (row[order][1:] == row[order][:-1])]
    n_dup_lines = np.bincount(row[later], minlength=n)
    line_size = chars[stop] - chars[begin]
    dup_line = _repeated(line_key, row)
    total = np.bincount(row, weights=line_size, minlength=n)
    dup_line_chars = np.bincount(row[dup_line], weights=line_size[dup_line], minlength=n) / np.maximum(total, 1)
    dup_line_share = n_dup_lines / np.maximum(np.bincount(row, minlength=n), 1)

    def covered(places: np.ndarray, width: int) -> np.ndarray:
        marks = np.zeros(len(starts) + 1, np.int64)
        np.add.at(marks, places, 1)
        np.add.at(marks, places + width, -1)
        return np.cumsum(marks)[:-1] > 0

    def windows(width: int, among: np.ndarray | None) -> np.ndarray:
        key = K.window_hashes(hashes, width)
        if not len(key):
            return np.zeros(0, np.int64)
        ok = doc[: len(key)] == doc[width - 1 :]
        places = np.flatnonzero(ok) if among is None else among[(among < len(key))]
        if among is not None:
            places = places[ok[places]]
        return places[_repeated(key[places] ^ salt[doc[places]], doc[places])] if len(places) else places

    triples = windows(3, None)
    n_repeat = K.row_sums(covered(triples, 3).astype(np.int64), first)
    shares, passed = [], np.ones(n, bool)
    among = triples
    for width, limit in rules.ngram_limits:
        among = windows(width, among)
        share = K.row_sums(np.where(covered(among, width), size, 0), first) / np.maximum(word_chars, 1)
        passed &= share <= limit
        shares.append(share)
    base_failed = (words < rules.min_words) | (100 * n_repeat > rules.max_repeat_words_percent * words)
    kept = ~base_failed & passed & (dup_line_share <= rules.max_dup_line_share) & (dup_line_chars <= rules.max_dup_line_chars)
    return {
        "n_words": words, "word_chars": word_chars, "n_symbols": K.row_sums(_SYMBOLS[data].astype(np.int64), offsets), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": kept, "dup_line_char_share": dup_line_chars, "dup_ngram_char_share": np.stack(shares, 1) if shares else np.zeros((n, 0)),
    }


def repetition_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document with its repetition figures and verdict, beside the columns ``keep``.

    A null or empty text has no words: all counts are 0, it fails the length rule and is not kept. Repeated rows are judged
    each by itself; other columns are never read, whatever their names. An empty table gives an empty result.
    """

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found = measure(data, offsets, rules)
        return [lists(found[name]) if kind.startswith("array") else pa.array(found[name]) for name, kind in RESULTS.items()]

    return annotated(docs, keep, text, [], lambda: kernel, RESULTS)

"""Quality by a factorisation machine.

Features are hashed words (unit length per text), structure statistics of the text, and its recorded length. Every
feature has a weight and a short factor vector; all pairwise interactions are summed in linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.llm import kernels as K
from canopyq.llm.labelled import SAMPLE_DOCUMENTS, held_out, labelled_count, labelled_sample, labelled_texts, mean_of_blocks, opened
from canopyq.llm.rows import annotated

BITS = 16
#: Texts that a word bucket with a weight is in at least.
LEAST = 5
FACTORS = 6

_UPPER, _DIGIT = K.byte_class(range(65, 91)), K.byte_class(range(48, 58))
_SYMBOL, _STOP = K.byte_class(*b"#*$%&|<>{}[]~^=_\\"), K.byte_class(*b".!?")
STATISTICS = (
    "log_words", "word_length", "symbols", "capitals", "digits", "spaces", "stops", "other_letters", "log_lines", "repeated_lines",
    "distinct_words", "symbol_words", "marks", "longest_word", "recorded_length", "length_gap",
)


@dataclass(frozen=True)
class FactorMachine:
    """Bias; weights and factors of word buckets, then of statistics; centre and scale of the statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probabilities of texts given as (row, bucket, value) entries in order of rows, and their statistics."""
        n = len(stats)
        x = np.clip((stats - self.centre) / self.scale, -4, 4).astype(np.float32)
        words = 1 << BITS
        z = self.bias + np.bincount(row, self.weights[bucket] * value, minlength=n) + x @ self.weights[words:]
        for f in range(self.factors.shape[1]):
            v, own = self.factors[:, f][bucket] * value, self.factors[words:, f] * x
            total = np.bincount(row, v, minlength=n) + own.sum(1)
            z += 0.5 * (total**2 - np.bincount(row, v * v, minlength=n) - (own**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word entries (row, bucket, value) and statistics of a chunk of texts; ``recorded`` is the length on record, -1 if none."""
    n = len(offsets) - 1
    starts, ends, first = K.runs(K.NONSPACE[data], offsets)
    words = np.diff(first)
    row, _ = K.spread(words)
    prefix = K.Prefix(data, K.FOLDED_VALUES)
    key = row << BITS | (prefix.span(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    entry, count = np.unique(key, return_counts=True)
    at, bucket = entry >> BITS, entry & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(at, count.astype(float) ** 2, minlength=n))
    value = (count / np.maximum(norm, 1)[at]).astype(np.float32)

    size = np.maximum(np.diff(offsets), 1)
    share = lambda table: K.row_sums(table[data].astype(np.int64), offsets) / size
    length = ends - starts
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=marks[1:])
    with_symbol = (marks[ends] > marks[starts]).astype(np.int64)
    pair = np.zeros(len(data), np.int64)
    pair[1:] = (data[1:] == data[:-1]) & ~K.ALNUM[data[1:]] & K.NONSPACE[data[1:]]
    begin, stop, line = K.pieces(data == 10, offsets)
    lines = np.bincount(line, minlength=n)
    line_key = np.unique(K.mix(line.astype(np.uint64) + np.uint64(1)) ^ prefix.span(begin, stop), return_index=True)[1]
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    chars = np.diff(K.code_points(data)[offsets])
    known = np.where(recorded < 0, chars, recorded)
    stats = np.stack([
        np.log1p(words), K.row_sums(length, first) / np.maximum(words, 1), share(_SYMBOL), share(_UPPER), share(_DIGIT), share(~K.NONSPACE), share(_STOP), share(~K.LEAD), np.log1p(lines),
        1 - np.bincount(line[line_key], minlength=n) / np.maximum(lines, 1), np.bincount(at, minlength=n) / np.maximum(words, 1), K.row_sums(with_symbol, first) / np.maximum(words, 1),
        K.row_sums(pair, offsets) / size, np.log1p(longest), np.log1p(known), np.log1p(np.abs(known - chars)),
    ], 1)
    return at, bucket, value, stats


def fit(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.05, l2: float = 1e-5, least: int = LEAST, seed: int = 7) -> FactorMachine:
    """Fits by Adam on the logistic loss. A row is its buckets and values; buckets in fewer than ``least`` rows stay 0."""
    words, k = 1 << BITS, len(STATISTICS)
    weights, factors = np.zeros(words + k, np.float32), np.zeros((words + k, FACTORS), np.float32)
    if not len(rows):
        return FactorMachine(0.0, weights, factors, np.zeros(k), np.ones(k))
    centre, scale = stats.mean(0), stats.std(0) + 1e-3
    start = np.zeros((words + k, FACTORS + 1))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    chosen, _, theta, bias = _descend(rows, np.clip((stats - centre) / scale, -4, 4), labels, start, float(np.log(share / (1 - share))), rounds, rate, l2, least, np.random.default_rng(seed))
    c = len(chosen)
    weights[chosen], weights[words:] = theta[:c, 0], theta[c:, 0]
    factors[chosen], factors[words:] = theta[:c, 1:], theta[c:, 1:]
    return FactorMachine(float(bias), weights, factors, centre, scale)


def _descend(rows: list, x: np.ndarray, labels: np.ndarray, start: np.ndarray, bias: float, rounds: int, rate: float, l2: float, least: int, random: np.random.Generator | None, part: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The buckets in ``least`` rows, how many have each, weights and factors of these and of the statistics, and the bias, after ``rounds`` rounds from ``start``.

    Factors are drawn first if ``random`` is given. Other buckets are left out. Gradients are summed over ``part`` rows at a time, so memory beyond the rows is a copy of their entries.
    """
    words, k = 1 << BITS, len(STATISTICS)
    spread = np.zeros(words, np.int64)
    for b, _ in rows:
        spread += np.bincount(b, minlength=words)
    chosen = np.flatnonzero(spread >= least)
    index = np.full(words, -1, np.int32)
    index[chosen] = np.arange(len(chosen), dtype=np.int32)
    c, n, parts = len(chosen), len(rows), []
    for begin in range(0, n, part):
        some = rows[begin : begin + part]
        word = index[np.concatenate([b for b, _ in some])]
        kept, row = word >= 0, np.repeat(np.arange(len(some), dtype=np.int32), [len(b) for b, _ in some])
        parts.append((slice(begin, begin + len(some)), row[kept], word[kept], np.concatenate([v for _, v in some])[kept]))
    theta = np.concatenate([start[chosen], start[words:]])
    if random is not None:
        theta[:, 1:] = random.normal(0, 0.05, (c + k, FACTORS))
    m, v = np.zeros((c + k + 1, FACTORS + 1)), np.zeros((c + k + 1, FACTORS + 1))
    for step in range(1, rounds + 1):
        grad, squares = np.zeros_like(m), np.zeros(c + k)
        for own_rows, row, word, value in parts:
            stats = x[own_rows]
            size = len(stats)
            z = bias + np.bincount(row, theta[word, 0] * value, minlength=size) + stats @ theta[c:, 0]
            totals = []
            for f in range(1, FACTORS + 1):
                e, own = theta[word, f] * value, theta[c:, f] * stats
                totals.append(total := np.bincount(row, e, minlength=size) + own.sum(1))
                z += 0.5 * (total**2 - np.bincount(row, e * e, minlength=size) - (own**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[own_rows]) / n
            each = g[row] * value
            grad[:c, 0] += np.bincount(word, each, minlength=c)
            grad[c:-1, 0] += stats.T @ g
            grad[-1, 0] += g.sum()
            squares[:c] += np.bincount(word, each * value, minlength=c)
            squares[c:] += (stats * stats).T @ g
            for f, total in enumerate(totals, 1):
                grad[:c, f] += np.bincount(word, each * total[row], minlength=c)
                grad[c:-1, f] += stats.T @ (g * total)
        grad[:-1, 1:] -= theta[:, 1:] * squares[:, None]
        grad[:-1] += l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        theta -= move[:-1]
        bias -= move[-1, 0]
    return chosen, spread[chosen], theta, bias


def refit(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray, model: FactorMachine, rounds: int = 20, rate: float = 0.02, l2: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block's fit from ``model`` on: its buckets, then the statistics, then the bias; the number of texts behind each; weights and factors.

    Buckets without factors begin with the same ones in every block, so that their means mean something.
    """
    words, n = 1 << BITS, len(rows)
    start = np.concatenate([model.weights[:, None], model.factors], 1).astype(np.float64)
    new = ~start[:, 1:].any(1)
    start[new, 1:] = np.random.default_rng(seed).normal(0, 0.05, (len(start), FACTORS))[new]
    chosen, spread, theta, bias = _descend(rows, np.clip((stats - model.centre) / model.scale, -4, 4), labels, start, model.bias, rounds, rate, l2, 1, None)
    k = len(STATISTICS)
    return np.concatenate([chosen, np.arange(words, words + k + 1)]), np.concatenate([spread, np.full(k + 1, n)]), np.concatenate([theta, np.append(bias, np.zeros(FACTORS))[None]])


def _inputs(docs: DataFrame, text: str) -> list:
    """The text and its length on record; without such a column the text's own length stands in."""
    recorded = docs["n_chars"].cast("long") if "n_chars" in docs.columns else docs[text].substr(1, 0).cast("long")
    return [docs[text].cast("string").alias("text"), recorded.alias("recorded")]


def _recorded(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", limit: int = SAMPLE_DOCUMENTS) -> FactorMachine:
    """Fits on all labelled documents outside the held-out fold; equal texts count once.

    A first fit sees ``limit`` of them and sets the scale of the statistics. Where there are more, every block of as many goes on from there in its own task, and weights and
    factors become their means over the blocks, weighted by the texts behind them; buckets in fewer than ``LEAST`` texts of all stay 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(0))
            recorded = _recorded(batch.column(1))
            for a, b, part, at in K.chunks(data, offsets):
                row, bucket, value, stats = features(part, at, recorded[a:b])
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pick(bucket.astype(np.int32)), pick(value), pa.array([s.tobytes() for s in stats])], ["label", "words", "shares", "stats"])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        for part in run(iter([opened(batch)])):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                yield len(row[1]) + len(row[2]), row

    def seen(found: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
        entries = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in found]
        stats = np.stack([np.frombuffer(r[3], np.float64) for r in found]) if found else np.zeros((0, len(STATISTICS)))
        return entries, stats, np.array([r[0] for r in found], float)

    texts = docs.select("doc_id", *_inputs(docs, text))
    sample = labelled_sample(texts, labels, label, limit).select("text", "recorded", "label")
    got = sample.mapInArrow(run, "label int, words binary, shares binary, stats binary").collect()
    model = fit(*seen(sorted({tuple(r) for r in got})))
    n = labelled_count(texts, labels, label)
    if n <= len(got):
        return model
    whole = {"rounds": 80, "rate": 0.05} if len({r["label"] for r in got}) < 2 else {}  # a first fit of one label is little to go on from
    every = labelled_texts(texts, labels, label).select("text", "recorded", "label").repartition(-(-n // limit))
    place, values = mean_of_blocks(every, rows, lambda block: refit(*seen(block), model, **whole), FACTORS + 1, f"n >= {LEAST} or place >= {1 << BITS}", 2 * limit)
    theta = np.concatenate([np.concatenate([model.weights[:, None], model.factors], 1), np.append(np.float32(model.bias), np.zeros(FACTORS, np.float32))[None]])
    theta[place] = values
    return FactorMachine(float(theta[-1, 0]), theta[:-1, 0].copy(), theta[:-1, 1:].copy(), model.centre, model.scale)


def score(docs: DataFrame, model: FactorMachine, keep: tuple[str, ...] = ("doc_id",), text: str = "text", where: str | None = None) -> DataFrame:
    """Scores every whole text; ``where``, a condition on the score, keeps the rows that meet it, without the score.

    Null and empty texts have their statistics alone. Repeated rows are scored each by itself; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(data: np.ndarray, offsets: np.ndarray, recorded: pa.Array) -> list[pa.Array]:
        return [pa.array(shared.value.score(*features(data, offsets, _recorded(recorded))))]

    _, recorded = _inputs(docs, text)
    return annotated(docs, keep, text, [recorded], lambda: kernel, {"score": "double"}, where)


def quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS, threshold: float = 0.3) -> DataFrame:
    """Trains on the labelled documents outside the held-out fold and scores all documents.

    Without labels every score is 0.5. An empty table of documents gives an empty result.
    """
    scored = score(docs, train(docs, labels, limit=limit))
    return scored.select("doc_id", held_out(scored["doc_id"]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

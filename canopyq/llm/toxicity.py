"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's probability is logistic in its hashed words and their beginnings, and a document's is their noisy-or: 1 - prod(1 - p). Training
sees document labels alone, yet its gradient reaches the sentences in proportion to their share of the blame, so the fitted model locates them.
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
from canopyq.llm.rows import Kernel, annotated

BITS = 22
#: About as many texts make a block of the fit over all of them, which holds their chosen features alone.
BLOCK = 20_000
#: Weight of the penalty, and the texts that a bucket with a weight is in at least.
L1, LEAST = 1e-4, 4
#: Bytes of the word beginnings that are features beside whole words: inflected forms share them.
STEMS = (5, 6, 7, 8, 10)
_BREAKS = K.byte_class(*b".!?\n")


@dataclass(frozen=True)
class NoisyOrModel:
    """Buckets that have a weight, their weights, and the bias of a sentence."""

    buckets: np.ndarray
    values: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Weights of all buckets."""
        weights = np.zeros(1 << BITS, np.float32)
        weights[self.buckets] = self.values
        return weights


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets, each feature's sentence in order, and the start, end and row of each sentence that has a word."""
    starts, ends, _ = K.runs(K.ALNUM[data], offsets)
    begin, stop, row = K.pieces(_BREAKS[data], offsets)
    place = np.searchsorted(begin, starts, "right") - 1
    used, place = np.unique(place, return_inverse=True)
    prefix = K.Prefix(data, K.FOLDED_VALUES)
    hashes, places = [~prefix.span(starts, ends)], [place]
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        hashes.append(prefix.span(starts[longer], starts[longer] + size))
        places.append(place[longer])
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    buckets = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return buckets[order], place[order], begin[used], stop[used], row[used]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 250, rate: float = 0.15, l1: float = L1, least: int = LEAST, part: int = 250, drop: float = 0.5, last: int = 80, seed: int = 3) -> NoisyOrModel:
    """Fits by proximal Adam on the noisy-or likelihood. A bag is its features' buckets, sentence after sentence, and the number of each sentence.

    Buckets in fewer than ``least`` bags keep weight 0. With no bag, or one label alone, the model says 0 or 1. Gradients are summed over ``part`` bags at a time, so memory
    beyond the bags themselves is small. In all but the ``last`` rounds a random half of the features is left out, so that each word of blame learns its own weight, not
    only the most frequent of those that occur together; the last rounds settle the level.
    """
    if not len(bags) or labels.min() == labels.max():
        return NoisyOrModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -12.0 if not len(bags) or labels.max() == 0 else 12.0)
    spread = _spread(bags)
    chosen = np.flatnonzero(spread >= least)
    w, bias = _descend(bags, labels, chosen, np.zeros(len(chosen)), -4.0, rounds, rate, l1, part, drop, last, seed)
    return NoisyOrModel(chosen[w != 0], w[w != 0].astype(np.float32), float(bias))


def _spread(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many bags each bucket is in."""
    spread = np.zeros(1 << BITS, np.int32)
    for buckets, _ in bags:
        spread[np.unique(buckets)] += 1
    return spread


def _descend(bags: list, labels: np.ndarray, chosen: np.ndarray, w: np.ndarray, bias: float, rounds: int, rate: float, l1: float, part: int, drop: float, last: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights of the chosen buckets and the bias after ``rounds`` rounds from the given ones."""
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen), dtype=np.int32)
    parts = []
    for begin in range(0, len(bags), part):
        some = bags[begin : begin + part]
        sizes = np.concatenate([c for _, c in some])
        word = index[np.concatenate([b for b, _ in some])]
        place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        parts.append((word[word >= 0], place[word >= 0], np.repeat(np.arange(len(some)), [len(c) for _, c in some]), labels[begin : begin + part]))
    random = np.random.default_rng(seed)
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, rounds + 1):
        g, used = np.zeros_like(m), random.random(len(chosen)) >= (drop if step <= rounds - last else 0.0)
        seen = w * used
        for word, place, bag, label in parts:
            z = np.clip(bias + np.bincount(place, seen[word], minlength=len(bag)), -30, 30)
            blame = 1 / (1 + np.exp(-z))
            clear = np.exp(-np.bincount(bag, np.logaddexp(0, z), minlength=len(label)))  # probability that no sentence is toxic
            pull = np.where(label == 1, -clear / np.maximum(1 - clear, 1e-9), 1.0)[bag] * blame / len(bags)
            g[:-1] += np.bincount(word, pull[place], minlength=len(chosen))
            g[-1] += pull.sum()
        g[:-1] *= used
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        size = np.sqrt(v / (1 - 0.99**step))
        move = rate * (m / (1 - 0.9**step)) / (size + 1e-8)
        bias -= move[-1]
        w -= move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (size[:-1] + 1e-6), 0)
    return w, bias


def gradient(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, model: NoisyOrModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of a block, how many bags have each, and the gradient of its weight at ``model``, summed over the bags, for each of these."""
    weights, spread = model.table(), _spread(bags)
    found = np.flatnonzero(spread)
    index, total = np.zeros(1 << BITS, np.int32), np.zeros(len(found))
    index[found] = np.arange(len(found), dtype=np.int32)
    for (words, sizes), label in zip(bags, labels, strict=True):
        place = np.repeat(np.arange(len(sizes)), sizes)
        z = np.clip(model.bias + np.bincount(place, weights[words], minlength=len(sizes)), -30, 30)
        clear = np.exp(-np.logaddexp(0, z).sum())
        pull = (-clear / max(1 - clear, 1e-9) if label == 1 else 1.0) / (1 + np.exp(-z))
        np.add.at(total, index[words], pull[place])
    return found, spread[found], (total / spread[found])[:, None]


def refit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, model: NoisyOrModel, chosen: np.ndarray, rounds: int = 250, rate: float = 0.15, drop: float = 0.5, last: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block's fit from ``model`` on: those of the chosen buckets that it has, the number of bags with each, and weights; the bias comes last, as bucket 2^BITS."""
    spread = _spread(bags)
    chosen = chosen[spread[chosen] > 0]
    w, bias = _descend(bags, labels, chosen, model.table()[chosen].astype(np.float64), model.bias, rounds, rate, L1, 250, drop, last, 3)
    return np.append(chosen, 1 << BITS), np.append(spread[chosen], len(bags)), np.append(w, bias)[:, None]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", limit: int = SAMPLE_DOCUMENTS) -> NoisyOrModel:
    """Fits on all labelled documents outside the held-out fold; equal texts count once.

    A first fit sees ``limit`` of them. Where there are more, the gradient over all of them at that model chooses the buckets beside the model's own: those in ``LEAST`` texts of all
    that the penalty doesn't hold at 0. Blocks of about ``BLOCK`` texts then fit these, each in its own task, and a weight becomes its mean over the blocks, weighted by the texts that hold the bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(0))
            for a, b, part, at in K.chunks(data, offsets):
                buckets, place, _, _, row = sentences(part, at)
                sizes = np.bincount(place, minlength=len(row)).astype(np.int32)
                words, counts = np.searchsorted(row[place], np.arange(b - a + 1)), np.searchsorted(row, np.arange(b - a + 1))
                cut = lambda x, at: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), cut(buckets.astype(np.int32), words), cut(sizes, counts)], ["label", "words", "sizes"])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        for part in run(iter([opened(batch)])):
            for mark, words, sizes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                yield len(words), (mark, words, sizes)

    def bags(found: list[tuple]) -> tuple[list, np.ndarray]:
        return [(np.frombuffer(words, np.int32), np.frombuffer(sizes, np.int32)) for _, words, sizes in found], np.array([mark for mark, _, _ in found], np.int64)

    texts = docs.select("doc_id", docs[text].cast("string").alias("text"))
    sample = labelled_sample(texts, labels, label, limit).select("text", "label")
    got = sample.mapInArrow(run, "label int, words binary, sizes binary").collect()
    model = fit(*bags(sorted({tuple(r) for r in got}, key=lambda r: (r[1], r[0], r[2]))))
    n = labelled_count(texts, labels, label)
    if n <= len(got):
        return model
    if len({r["label"] for r in got}) < 2:  # nothing to go on from
        model = NoisyOrModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -4.0)
    every = labelled_texts(texts, labels, label).select("text", "label")
    pulled, _ = mean_of_blocks(every, rows, lambda block: gradient(*bags(block), model), 1, f"n >= {LEAST} and abs(n * v0) > {L1 * n!r}", limit)
    chosen = np.union1d(pulled, model.buckets)

    def compact(content: pa.Array) -> pa.Array:
        known = np.zeros(1 << BITS, bool)
        known[chosen] = True
        out = []
        for part in run(iter([pa.RecordBatch.from_arrays([content, pa.array(np.zeros(len(content), np.int32))], ["text", "label"])])):
            for words, sizes in bags(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))[0]:
                kept = known[words]
                counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
                out.append(np.concatenate([[len(sizes)], counts, words[kept]]).astype(np.int32).tobytes())
        return pa.array(out, pa.binary())

    def as_sent(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        for sent, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cut = 4 + 4 * int.from_bytes(sent[:4], "little")
            yield len(sent), (mark, sent[cut:], sent[4:cut])

    blocks = labelled_texts(texts, labels, label, compact).select("text", "label").repartition(-(-n // BLOCK))
    place, values = mean_of_blocks(blocks, as_sent, lambda block: refit(*bags(block), model, chosen), 1, "true", 2 * BLOCK)
    weights = np.append(model.table().astype(np.float64), model.bias)
    weights[place] = values[:, 0]
    used = np.flatnonzero(weights[:-1])
    return NoisyOrModel(used, weights[used].astype(np.float32), float(weights[-1]))


RESULTS = {"score": "double", "n_sentences": "long", "spans": "array<struct<start: long, end: long, score: double>>"}


def score(docs: DataFrame, model: NoisyOrModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.5, where: str | None = None) -> DataFrame:
    """Scores every whole text and locates its offending sentences; ``where``, a condition on the results, keeps the rows that meet it, without the results.

    ``spans`` holds the sentences whose own probability reaches ``threshold``: start and end in characters, and the probability.
    Null and empty texts have no sentence and score 0. Repeated rows are scored each by itself; other columns are never read.
    """

    def make() -> Kernel:
        weights = model.table()
        return lambda data, offsets: measured(data, offsets, weights)

    def measured(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> list[pa.Array]:
        bias, n = model.bias, len(offsets) - 1
        buckets, place, begin, stop, row = sentences(data, offsets)
        z = np.clip(bias + np.bincount(place, weights[buckets], minlength=len(row)), -30, 30)
        log_clear = -np.bincount(row, np.logaddexp(0, z), minlength=n)
        p = 1 / (1 + np.exp(-z))
        bad = np.flatnonzero(p >= threshold)
        chars = K.code_points(data)
        base = chars[offsets[:-1]][row[bad]]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(row[bad], np.arange(n + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(chars[begin[bad]] - base), pa.array(chars[stop[bad]] - base), pa.array(p[bad])], ["start", "end", "score"]),
        )
        return [pa.array(-np.expm1(log_clear)), pa.array(np.bincount(row, minlength=n)), spans]

    return annotated(docs, keep, text, [], make, RESULTS, where)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Trains on the labelled documents outside the held-out fold and scores all documents.

    An empty table of labels gives a model that scores 0 everywhere; an empty table of documents an empty result.
    """
    scored = score(docs, train(docs, labels, limit=limit))
    return scored.select("doc_id", held_out(scored["doc_id"]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "spans")

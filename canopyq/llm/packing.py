"""Best-fit packing of token sequences with a bounded number of open bins.

Pieces arrive in document order, in windows of a fixed number of pieces that are placed from the longest down. A fixed number of bins is open at once, in a bitset keyed by free space: the
lowest set bit at or above a piece's length is the tightest bin that takes it. When a new bin would exceed the bound, the
fullest one closes. Each task packs its own split, so nothing is shuffled, memory is fixed, and a lost task is recomputed with the same result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from canopyq.llm import kernels as K
from canopyq.llm.rows import in_small_batches
from canopyq.llm.tokens import ByteLevelEncoder, default_path


class OpenBins:
    """Online best fit with at most ``bound`` open bins of ``capacity``."""

    def __init__(self, capacity: int, bound: int) -> None:
        self.capacity, self.bound = capacity, bound
        self.free_bits, self.open, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = defaultdict(list)

    def _put(self, number: int, free: int) -> None:
        if free:
            self.bins[free].append(number)
            self.free_bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the piece's offset in it."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.bound and length < self.capacity:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        self._put(number, free - length)
        return number, self.capacity - free


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only what exceeds a sequence is cut, and the first piece takes the remainder."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)] if length else []


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 1024, open_bins: int = 1024, window: int = 2048, end_id: int = 2, text: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; one row for each piece.

    A null or empty text is its end token alone, so every row of the input is packed, repeated rows too. Extra columns are never read.
    An empty table gives no piece. ``sequence_id`` holds the task's number above its own count of sequences.
    """
    path = tokenizer_path or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = ByteLevelEncoder(path), OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 33
        waiting: list[tuple[int | None, int, int, int, int]] = []

        def placed() -> pa.RecordBatch:
            waiting.sort(key=lambda p: -p[3])
            places = [bins.place(p[3]) for p in waiting]
            ids, *rest = zip(*waiting, strict=True)
            columns = [*rest, [base + number for number, _ in places], [offset for _, offset in places]]
            kinds = [pa.int32(), *[pa.int64()] * 5]
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns, kinds)], NAMES)
            waiting.clear()
            return batch

        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(1))
            for a, b, part, at in K.chunks(data, offsets):
                flat, bounds = encoder.encode(part, at)
                flat = np.insert(flat, bounds[1:], end_id).astype("<u4", copy=False)
                bounds = bounds + np.arange(len(bounds))
                for i, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    begin = int(bounds[i])
                    for k, (start, length) in enumerate(cut(int(bounds[i + 1]) - begin, capacity)):
                        waiting.append((key, k, start, length, zlib.crc32(flat[begin + start : begin + start + length])))
                if len(waiting) >= window:
                    yield placed()
        if waiting:
            yield placed()

    return in_small_batches(docs.select(docs["doc_id"].cast("long"), docs[text].cast("string"))).mapInArrow(K.given_back(run), SCHEMA)

"""Vectorised text kernels over Arrow string buffers.

A chunk of documents is one ``uint8`` array with row offsets. Words and lines are
found by byte classes, and hashed with a polynomial modulo the prime 2**61 - 1:
sums over spans hash all words of a chunk at once, so whole chunks are tokenised and
hashed without a Python loop over words. The prime matters: modulo a power of two, strings built
like the Thue-Morse sequence collide whatever the base. Temporary memory is a small multiple of
the chunk, never of the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Hashes are values of polynomials modulo this prime, 2**61 - 1.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = 0x1D8AF5C31A6E9B47 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: One value for each byte, none of them 0, so that strings of different lengths are different polynomials.
BYTE_VALUES = np.arange(1, 257, dtype=np.uint64)
#: The same with A-Z folded onto a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
#: Longer spans are hashed by a digest, so tables of powers stay small.
_LONG = 1 << 16
#: Bytes of spans that are hashed at once.
_SPAN_BYTES = 1 << 17


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, from products of halves of 30 and 31 bits that don't overflow."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = ah * bl + al * bh
    out = (ah * bh << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + al * bl
    return _reduced(out)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo the prime."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p, filled = np.ones(size, np.uint64), 1
            while filled < size:
                p[filled : 2 * filled] = times(p[:filled], np.uint64(pow(base, filled, PRIME)))
                filled *= 2
            _powers[k] = p
    return _powers[0][:n], _powers[1][:n]


def byte_class(*members: int | range) -> np.ndarray:
    """A boolean table of 256 entries that is true for the given bytes."""
    table = np.zeros(256, bool)
    for m in members:
        table[list(m) if isinstance(m, range) else m] = True
    return table


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are folded: digits, letters and every byte of a non-ASCII character.
ALNUM = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = ~byte_class(0x20, range(0x09, 0x0E))
#: First bytes of characters.
LEAD = ~byte_class(range(0x80, 0xC0))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefix:
    """Hashes of spans of one chunk: of its bytes' ``values`` as coefficients, the first byte's lowest."""

    def __init__(self, data: np.ndarray, values: np.ndarray) -> None:
        self.data, self.values = data, values

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal spans wherever they stand; different spans agree by chance alone, once in 2**61 for each byte of the longer.

        Spans are handled some at a time, so temporary memory is bounded for a text of any length.
        """
        length = ends - starts
        out = np.zeros(len(starts), np.uint64)
        long = length > _LONG
        for i in np.flatnonzero(long).tolist():
            digest = blake2b(self.values[self.data[starts[i] : ends[i]]].astype("<u2").tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        some = np.flatnonzero((length > 0) & ~long)
        upto = np.cumsum(length[some])
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _SPAN_BYTES, "right")))
            part = some[at:end]
            out[part] = self._hash(starts[part], length[part])
            at = end
        out[length == 0] = mix(np.zeros(1, np.uint64))[0]
        return out

    def _hash(self, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int32)
        terms = self.values[self.data[place + np.repeat(starts - first, length)]]
        place -= np.repeat(first.astype(np.int32), length)
        high, low = _halves(int(length.max()))
        high = np.add.reduceat(terms * high[place], first)
        terms *= low[place]
        return mix(_reduced(times(_reduced(high), np.uint64(1 << 31)) + _reduced(np.add.reduceat(terms, first))))


_tables = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the first ``n`` powers at least."""
    if len(_tables[0]) < n:
        p, _ = powers(1 << int(n).bit_length())
        _tables[:] = p >> np.uint64(31), p & _LOW31
    return _tables[0], _tables[1]


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of every window of ``n`` consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, _ = powers(n)
    out = np.zeros(m, np.uint64)
    if n <= 12:  # a few shifted products cost less than prefix sums
        for k in range(n):
            out = _reduced(out + times(_reduced(values[k : k + m]), p[k]))
        return mix(out)
    p, inverse = powers(len(values) + 1)
    terms = times(_reduced(values), p[:-1])
    high, low = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms >> np.uint64(31), out=high[1:])
    np.cumsum(terms & _LOW31, out=low[1:])
    sums = _reduced(times(_reduced(high[n:] - high[:m]), np.uint64(1 << 31)) + _reduced(low[n:] - low[:m]))
    return mix(times(sums, inverse[:m]))


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """True where the spans of ``length`` bytes at ``a`` and at ``b`` hold the same bytes, compared eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    out, at, open_rows = np.ones(len(a), bool), 0, np.arange(len(a))
    while len(open_rows):
        rest = np.minimum(length[open_rows] - at, 8)
        drop = ((8 - rest) * 8).astype(np.uint64)
        with np.errstate(over="ignore"):
            gap = (eight[a[open_rows] + at] ^ eight[b[open_rows] + at]) << np.minimum(drop, np.uint64(63))
        differ = (gap != 0) & (rest > 0)
        out[open_rows[differ]] = False
        open_rows, at = open_rows[~differ & (rest == 8)], at + 8
    return out


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with the memory that Arrow's pool keeps of earlier ones given back between them, and what the allocator keeps after the last: Python workers outlive tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run``, with all that it held given back to the system once it has ended, its tables and last results too, which ``lean`` comes too early for."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Returns freed memory to the system, Arrow's and, where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross rows: starts, ends, and for each row the index of its first run."""
    n = len(member)
    first, last = np.empty(n, bool), np.empty(n, bool)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first[0], last[-1] = member[0], member[-1]
    np.logical_and(member[1:], ~member[:-1], out=first[1:])
    np.logical_and(member[:-1], ~member[1:], out=last[:-1])
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = member[heads], member[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows split after each true byte: starts, ends (the break is left out), row index. Empty rows give one empty piece."""
    at = np.flatnonzero(breaks)
    rows = np.searchsorted(offsets, at, "right") - 1
    starts = np.concatenate([offsets[:-1], at + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), rows])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1] = starts[1:] - 1
        final = np.append(row[1:] != row[:-1], True)
        ends[final] = offsets[1:][row[final]]
    return starts, ends, row


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's span; empty spans give 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows: the row of each element and its place in that row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    return row, np.arange(len(row)) - begin[row]


def gather_ragged(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the ragged rows ``pick`` of ``flat``, and its offsets."""
    lens = length[pick]
    offsets = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    return flat[np.repeat(begin[pick] - offsets[:-1], lens) + np.arange(offsets[-1])], offsets


def code_points(data: np.ndarray) -> np.ndarray:
    """``c[i]``: characters before byte ``i``."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LEAD[data], out=c[1:])
    return c

"""Splitting into pre-tokens in numpy, and tables that encode each distinct pre-token once.

Two splitting schemes are covered, those of the byte-level and of the word-end vocabulary. They
run on bytes for texts of ASCII and two-byte Latin letters; any other text (marked by ``plain``) goes to the tokenizer
library's own splitter. Both give the same pre-tokens; tests compare them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from canopyq.llm import kernels as K

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3

#: Byte -> class. Lead bytes C3-C9 begin U+00C0-U+027F, all letters but U+00D7 and U+00F7.
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[list(range(9, 14)) + [32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[0x80:0xC0] = LETTER
_CLASS[0xC3:0xCA] = LETTER
#: Bytes of characters outside that range.
_FOREIGN = K.byte_class(0xC0, 0xC1, 0xC2, range(0xCA, 0x100))

#: Special tokens that the vocabularies take whole when they occur in a text.
_SPECIAL = (b"<|endoftext|>", b"<|startoftext|>")


def default_path(name: str) -> str:
    """Where the installed vocabulary files are; queries take another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if visible in Latin-1, else the next from U+0100."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    letters = {b: chr(b) for b in visible}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(visible)))
    return [letters[b] for b in range(256)]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that the byte splitters handle: known letters only and no special token's text."""
    bad = _FOREIGN[data]
    sign = np.flatnonzero(data[:-1] == 0xC3)
    bad[sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]] = True
    ok = K.row_sums(bad.astype(np.int64), offsets) == 0
    mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else ()
    if len(mark):
        for row in np.unique(np.searchsorted(offsets, mark, "right") - 1):
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            ok[row] &= not any(s in text for s in _SPECIAL)
    return ok


def _contractions(data: np.ndarray, starts: np.ndarray, row_end: np.ndarray) -> None:
    """Moves starts for 's 't 'm 'd 're 've 'll where the apostrophe begins a pre-token."""
    n = len(data)
    at = np.flatnonzero((data == 0x27) & starts)
    if not len(at):
        return
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two, end = padded[at + 1], padded[at + 2], row_end[at]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < end)
    long = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & (at + 2 < end)
    for where, size in ((at[short], 2), (at[long & ~short], 3)):
        starts[where + 1] = False
        after = where + size
        starts[after[(after < n)]] = True


def _prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cls = _CLASS[data]
    head = np.zeros(len(data), bool)
    head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    change = head.copy()
    change[1:] |= cls[1:] != cls[:-1]
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    return cls, head, change, row_end


def _closed(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], n) if len(begin) else begin


def split_byte_level(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the byte-level scheme: a space joins what follows it, the last space of a run stands apart."""
    cls, head, change, row_end = _prepared(data, offsets)
    starts = change
    after = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~head[1:]) + 1
    starts[after] = data[after - 1] != 0x20
    starts[after - 1] = True
    _contractions(data, starts, row_end)
    return _closed(starts, len(data))


def split_word_end(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the word-end scheme on lower-cased text: single digits, white space dropped."""
    cls, _, change, row_end = _prepared(data, offsets)
    starts = change | (cls == DIGIT)
    _contractions(data, starts, row_end)
    begin, end = _closed(starts, len(data))
    kept = cls[begin] != SPACE
    return begin[kept], end[kept]


class WordTable:
    """Token ids of distinct pre-tokens, encoded in batches when first seen.

    ``encode`` maps a list of byte strings to lists of ids. At ``limit`` words or ``most_bytes``, whichever comes first, the table starts anew, so a
    worker's memory is bounded whatever the vocabulary of the corpus, and however long its words are.
    """

    #: How often a word's bytes are kept, its ids included, and what a word costs besides.
    copies, overhead = 2, 150

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = 400_000, most_bytes: int = 40 << 20) -> None:
        self.encode, self.limit, self.most_bytes = encode, limit, most_bytes
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.on_clear()

    def on_clear(self) -> None:
        """For subclasses that keep more about each word."""

    def on_new(self, ids: list[list[int]]) -> None:
        """For subclasses that keep more about each word."""

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each span of ``data``. Words are told apart by their bytes; a hash only brings equal ones of a chunk together."""
        if not len(starts):
            return np.zeros(0, np.int64)
        _, first, inverse = np.unique(K.Prefix(data, K.BYTE_VALUES).span(starts, ends), return_index=True, return_inverse=True)
        length, head = ends - starts, first[inverse]
        odd = np.flatnonzero((length != length[head]) | ~K.same_spans(data, starts, starts[head], np.minimum(length, length[head])))
        if len(odd):  # the hash took two words for one: these go by themselves
            inverse[odd] = len(first) + np.arange(len(odd))
            first = np.append(first, odd)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.rows) + len(keys) > self.limit:
            self.clear()
        found = list(map(self.rows.get, keys))
        new = list(dict.fromkeys(k for k, x in zip(keys, found, strict=True) if x is None))
        cost = self.copies * sum(map(len, new)) + self.overhead * len(new)
        if new and self.rows and self.held + cost > self.most_bytes:
            self.clear()
            found, new = [None] * len(keys), list(dict.fromkeys(keys))
            cost = self.copies * sum(map(len, new)) + self.overhead * len(new)
        if new:
            self.held += cost
            ids = self.encode(new)
            self._append(ids)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.on_new(ids)
            found = [self.rows[k] if x is None else x for k, x in zip(keys, found, strict=True)]
        return np.array(found, np.int64)[inverse]

    def _append(self, ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(lens.sum()), len(self.rows)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.length[n : n + len(ids)] = lens
        self.begin[n : n + len(ids)] = self.used + np.cumsum(lens) - lens
        self.used += total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of ids of each span of ``data``."""
        rows = self.look_up(data, starts, ends)
        return self.length[rows]

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``rows`` one after another, and where each word's begin."""
        return K.gather_ragged(self.flat, self.begin, self.length, rows)


def library_table(tokenizer) -> WordTable:
    """A table whose words the library's byte-level model encodes: single pre-tokens, so its splitter needn't see them again, or special tokens."""
    letters, merged = dict(enumerate(byte_letters())), tokenizer.model.tokenize
    special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode(words: list[bytes]) -> list[list[int]]:
        return [[special[w]] if w in special else [token.id for token in merged(w.decode("latin-1").translate(letters))] for w in words]

    return WordTable(encode)


class ByteLevelEncoder:
    """Whole texts to ids of a byte-level vocabulary, each distinct pre-token encoded once per worker."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.table = library_table(self.tokenizer)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and each row's offset in them."""
        fast = plain(data, offsets)
        starts, ends = split_byte_level(data, offsets)
        if not fast.all():
            keep = fast[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        flat, at = self.table.ids(self.table.look_up(data, starts, ends))
        bounds = at[np.searchsorted(starts, offsets)]
        if fast.all():
            return flat, bounds
        parts = [flat[bounds[i] : bounds[i + 1]] for i in range(len(fast))]
        for i in np.flatnonzero(~fast):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

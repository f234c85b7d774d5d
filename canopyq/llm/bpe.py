"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct new words of a chunk are laid out, a group at a time, as one linked list of symbols. An index maps each mergeable pair to
all its positions; a heap holds the ranks that occur. Ranks are applied in ascending order over all words of a group at once, and each merge adds
the two pairs it makes to their lists. Entries that a merge has outdated are told by their symbols.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopyq.llm import kernels as K
from canopyq.llm.rows import in_small_batches
from canopyq.llm.tokens import WordTable, byte_letters, default_path, load_tokenizer, plain, split_word_end

_SHIFT = 20

#: Words that are merged together.
GROUP_WORDS = 1000


class PairIndex:
    """Merges of a vocabulary file, applied to many words at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.names = {i: t for t, i in vocab.items()}
        self.id_bytes = {i: b"%d" % i for i in self.names}
        self.name_bytes = {i: t.encode() for i, t in self.names.items()}
        self.rank: dict[int, int] = {}
        self.pair: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[left] << _SHIFT | vocab[right]] = len(self.pair)
            self.pair.append((vocab[left], vocab[right], vocab[left + right]))
        self.keys = np.array(sorted(self.rank), np.int64)
        self.rank_of_key = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)

    def occurrences(self, symbols: np.ndarray) -> dict[int, list[int]]:
        """The places of each rank among neighbouring symbols, in ascending order."""
        left, right = symbols[:-1], symbols[1:]
        places = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[places] << _SHIFT | right[places]
        row = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[row] == keys if len(self.keys) else np.zeros(len(keys), bool)
        ranks, places = self.rank_of_key[row[known]], places[known]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], places[order].tolist()
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        return {r: at[a:b] for r, a, b in zip(ranks[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True)} if len(at) else {}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        data, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        if not len(data):
            return [[] for _ in words]
        ids = self.inner[data]
        full = np.diff(offsets) > 0
        ids[offsets[1:][full] - 1] = self.final[data[offsets[1:][full] - 1]]
        # A bar of -1 before each word and at the end keeps pairs inside words.
        symbols = np.insert(ids, offsets[:-1], -1)
        symbol: list[int] = [*symbols.tolist(), -1]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, pair = self.rank, self.pair
        where = self.occurrences(symbols)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = pair[r]
            places = where.pop(r)
            places.sort()
            for i in places:
                if symbol[i] != a:
                    continue  # an earlier merge took one of the two
                j = after[i]
                if symbol[j] != b:
                    continue
                h, k = before[i], after[j]
                symbol[i], symbol[j] = c, -2
                after[i], before[k] = k, i
                x, y = symbol[h], symbol[k]
                if x >= 0:
                    s = rank.get(x << _SHIFT | c)
                    if s is not None:
                        if s in where:
                            where[s].append(h)
                        else:
                            where[s] = [h]
                            heapq.heappush(active, s)
                if y >= 0:
                    s = rank.get(c << _SHIFT | y)
                    if s is not None:
                        if s in where:
                            where[s].append(i)
                        else:
                            where[s] = [i]
                            heapq.heappush(active, s)
        done = np.array(symbol)
        bars = np.flatnonzero(done == -1)
        kept = done >= 0
        out = done[kept].tolist()
        cuts = np.concatenate([[0], np.cumsum(kept)])[bars].tolist()
        return [out[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


class _TextTable(WordTable):
    """Keeps each word's ids and token names as text, ready to be joined."""

    copies, overhead = 5, 250

    def __init__(self, index: PairIndex) -> None:
        self.index = index
        super().__init__(self._by_groups, 400_000)

    def _by_groups(self, words: list[bytes]) -> list[list[int]]:
        """Groups of words whose linked lists stay in the processor's cache: places are visited by rank, all over the lists."""
        return [ids for a in range(0, len(words), GROUP_WORDS) for ids in self.index.encode(words[a : a + GROUP_WORDS])]

    def on_clear(self) -> None:
        self.id_text: list[bytes] = []
        self.name_text: list[bytes] = []

    def on_new(self, ids: list[list[int]]) -> None:
        number, name = self.index.id_bytes, self.index.name_bytes
        self.id_text += [b" ".join([number[i] for i in x]) for x in ids]
        self.name_text += [b" ".join([name[i] for i in x]) for x in ids]


class WordEndCodec:
    """Encoding and decoding of whole texts with a word-end vocabulary."""

    def __init__(self, path: str) -> None:
        self.library = load_tokenizer(path)
        self.table = _TextTable(PairIndex(path))
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, hash of the ids and hash of the decoded text, of each text."""
        data, offsets = K.string_parts(pa.array([t.lower() for t in texts], pa.large_string()))
        fast = plain(data, offsets)
        starts, ends = split_word_end(data, offsets)
        rows = self.table.look_up(data, starts, ends)
        lengths = self.table.length[rows]
        counts = K.row_sums(lengths, bounds := np.searchsorted(starts, offsets))
        id_text, name_text, picks, at = self.table.id_text, self.table.name_text, rows.tolist(), bounds.tolist()
        quick = []
        for i, text in enumerate(texts):
            if fast[i] and "İ" not in text:
                mine = picks[at[i] : at[i + 1]]
                quick.append((int(counts[i]), b" ".join([id_text[r] for r in mine]), b" ".join([name_text[r] for r in mine])))
            else:
                quick.append(None)
        for text, found in zip(texts, quick, strict=True):
            ids, ids_text, names = found or self._careful(text)
            yield ids, sha256(ids_text).hexdigest(), sha256(names).hexdigest()

    def _careful(self, text: str) -> tuple[int, bytes, bytes]:
        """For texts with special tokens or other scripts: the library normalises and splits, the index encodes."""
        ids: list[int] = []
        for piece in self.cut.split(text):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                code = _letter_bytes()
                ids += [i for x in self.table.index.encode([bytes(code[c] for c in w) for w, _ in words]) for i in x]
        names = self.table.index.names | {i: t for t, i in self.special.items()}
        return len(ids), " ".join(map(str, ids)).encode(), " ".join(names[i] for i in ids).encode()


_codes: dict[str, int] = {}


def _letter_bytes() -> dict[str, int]:
    if not _codes:
        _codes.update({c: b for b, c in enumerate(byte_letters())})
    return _codes


def bpe_round_trip(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; one row for each row of the input.

    Null and empty texts have no ids: 0 and the hash of nothing twice. Special tokens that occur in a text take their own ids.
    Repeated rows give repeated results, other columns are never read, an empty table gives an empty result.
    """
    path = tokenizer_path or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordEndCodec(path)
        for batch in K.lean(batches):
            _, offsets = K.string_parts(batch.column(1))
            for a, b, _, _ in K.chunks(np.zeros(int(offsets[-1]), np.uint8), offsets):
                found = list(codec.digest([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]))
                n, ids, names = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids), pa.array(names)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_small_batches(docs.select(docs["doc_id"].cast("long"), docs[text].cast("string"))).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Removal of passages that earlier documents hold, word windows told apart by anchors at difference-cover positions.

The places 0, 1 and 3 modulo 7 are a difference cover: whatever the distance of two places, some offset below 7 puts both at cover places. So two equal windows of 13 words
share an anchor, the 7 words at a cover place, at the same offset: only anchors, 3 of 7 places, are hashed and gathered. Windows around an anchor that
several documents share are then extended to their 13 words, and gathered in turn with the smallest document of each.

Documents are dealt once to blocks of bounded bytes; a block sends a hash at most once, and gets back at most once what is known of it. So a passage that a third of all documents
share costs a row a block, and no task holds a passage's documents. Copies of a text are told by digest and judged once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.llm import kernels as K
from canopyq.plans.salted import with_group_values
from canopyq.plans.storage import discard, stored

#: Words of a window, and of an anchor; an anchor at one of the cover's places fits into every window.
WINDOW, ANCHOR = 13, 7
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20

_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Values of bytes for a second hash: each byte's stands at another place.
_OTHER_VALUES = (np.arange(256, dtype=np.uint64) * np.uint64(167) + np.uint64(13)) % np.uint64(256) + np.uint64(1)


class Words:
    """The words of a chunk of texts, their hashes, and places of windows that stay within a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.at = K.runs(K.NONSPACE[data], offsets)
        self.counts = np.diff(self.at)
        self.hashes = K.Prefix(data, K.BYTE_VALUES).span(self.starts, self.ends)
        self.row, self.place = K.spread(self.counts)

    def windows(self, n: int) -> np.ndarray:
        """True at words where ``n`` words of the same text begin."""
        return self.place + n <= self.counts[self.row]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Words where an anchor begins, and the anchors' hashes of 48 bits: one that stands for two anchors only costs rows."""
        at = np.flatnonzero(_COVERED[self.place % PERIOD] & self.windows(ANCHOR))
        return at, (_window_hashes(self.hashes, ANCHOR)[at] >> np.uint64(16)).view(np.int64)

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return _window_hashes(self.hashes, WINDOW)[at].view(np.int64)

    def second_hashes(self, at: np.ndarray) -> np.ndarray:
        """32 bits for each window in ``at``, of other values of its bytes."""
        used = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(used, at, 1)
        np.add.at(used, at + WINDOW, -1)
        some = np.flatnonzero(np.cumsum(used)[:-1] > 0)
        values = np.zeros(len(self.starts), np.uint64)
        values[some] = K.Prefix(self.data, _OTHER_VALUES).span(self.starts[some], self.ends[some])
        return (_window_hashes(values, WINDOW)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def kept(self, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each text's words that aren't removed, joined by spaces, and their offsets."""
        stay = np.flatnonzero(~removed)
        length = self.ends[stay] - self.starts[stay] + 1
        total = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(self.starts[stay] - total[:-1], length) + np.arange(total[-1])
        out = np.append(self.data, np.uint8(0x20))[np.minimum(source, len(self.data))]
        out[total[1:] - 1] = 0x20
        return out, total[np.searchsorted(stay, self.at)]


def _window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes, one for each value; those of windows that don't fit are 0."""
    found = K.window_hashes(values, n)
    return np.concatenate([found, np.zeros(len(values) - len(found), np.uint64)])


def _words_of(table: pa.Table, known: pa.Table, copies: bool = False):
    """Each chunk of a block's texts: its words, their documents' ids, and which words are judged. Words of documents without an id aren't, nor those of later copies of a text.

    With ``copies`` comes which of the chunk's documents are later copies.
    """
    data, offsets = K.string_parts(table["text"])
    ids, keys = table["doc_id"].combine_chunks(), table["key"].to_numpy()
    judged, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    later = set(zip(*(known[c].drop_null().to_pylist() for c in ("doc_id", "key")), strict=True))
    again = np.array([pair in later for pair in zip(ids.tolist(), keys.tolist(), strict=True)], bool) & judged
    judged &= ~again
    for a, b, part, at in K.chunks(data, offsets):
        words = Words(part, at)
        found = words, ids[a:b][words.row], judged[a:b][words.row]
        yield (*found, again[a:b]) if copies else found


def _gathered(parts: list[tuple[np.ndarray, ...]], kinds: tuple[type, ...]) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds)]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _held(known: pa.Table) -> pa.Table:
    """The rows of what a block gets back that are hashes."""
    return known.filter(pc.is_valid(known["hash"]))


def block_anchors(table: pa.Table, known: pa.Table) -> pa.Table:
    """The different anchors of a block, and whether several of its documents hold them."""
    parts = []
    for words, ids, judged in _words_of(table, known):
        at, hashes = words.anchors()
        parts.append((hashes[judged[at]], ids[at][judged[at]]))
    hashes, ids = _gathered(parts, (np.int64, np.int64))
    order, first = _groups(hashes)
    low, high = _extremes(ids[order], first)
    return pa.table({"hash": hashes[order][first], "block": np.repeat(table["block"][0].as_py(), len(first)), "several": low < high})


def block_windows(table: pa.Table, known: pa.Table) -> pa.Table:
    """The different windows of a block that hold a shared anchor: hash, second hash, smallest document, whether several documents hold it, and whether the first hash stands for other windows too."""
    anchors, parts = np.sort(_held(known)["hash"].to_numpy()), []
    for words, ids, judged in _words_of(table, known):
        at, hashes = words.anchors()
        found = at[_among(hashes, anchors)]
        near = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(near, np.maximum(found - (WINDOW - ANCHOR), words.at[words.row[found]]), 1)
        np.add.at(near, found + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & words.windows(WINDOW) & judged)
        parts.append((words.window_hashes(at), words.second_hashes(at), ids[at]))
    hashes, second, ids = _gathered(parts, (np.int64, np.int32, np.int64))
    order, first = _groups(hashes, second)
    low, high = _extremes(ids[order], first)
    pick = order[first]
    alike = hashes[pick][1:] == hashes[pick][:-1]
    clash = np.append(alike, False) | np.insert(alike, 0, False) if len(pick) else np.zeros(0, bool)
    return pa.table({"hash": hashes[pick], "low": low, "second": second[pick], "block": np.repeat(table["block"][0].as_py(), len(first)), "several": low < high, "clash": clash})


def _extremes(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest of each group."""
    return (np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)) if len(ids) else (ids, ids)


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes stand in a sorted table."""
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def block_texts(table: pa.Table, known: pa.Table) -> pa.Table:
    """Each document of a block with the words that stay. ``known`` holds windows and the smallest document of each; a second hash stands only where the first one clashes."""
    repeated = _held(known).sort_by("hash")
    hashes, firsts, seconds = repeated["hash"].to_numpy(), repeated["first"].to_numpy(), repeated["second"]
    clashing, seconds = seconds.is_valid().to_numpy(), seconds.fill_null(0).to_numpy()
    n_words, n_removed, texts = [], [], []
    for words, ids, judged, again in _words_of(table, known, copies=True):
        removed = (again & (words.counts >= WINDOW))[words.row]
        at = np.flatnonzero(words.windows(WINDOW) & judged)
        own = words.window_hashes(at)
        some = np.flatnonzero(_among(own, hashes))
        at, own = at[some], own[some]
        place, hit = np.searchsorted(hashes, own), np.zeros(len(at), bool)
        second = words.second_hashes(at) if clashing.any() else np.zeros(len(at), np.int32)
        while len(at):  # once, but for windows whose first hashes clash
            here = np.minimum(place, len(hashes) - 1)
            same = (place < len(hashes)) & (hashes[here] == own)
            hit |= same & (firsts[here] < ids[at]) & (~clashing[here] | (seconds[here] == second))
            place = place + 1
            if not (same & clashing[here]).any():
                break
        cover = np.zeros(len(removed) + 1, np.int64)
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + WINDOW, -1)
        removed |= np.cumsum(cover)[:-1] > 0
        n_words.append(words.counts)
        n_removed.append(K.row_sums(removed.astype(np.int64), words.at))
        data, offsets = words.kept(removed)
        raw = data.tobytes()
        texts += [raw[a : max(a, b - 1)].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.table({"doc_id": table["doc_id"], "n_words": np.concatenate(n_words), "n_removed": np.concatenate(n_removed), "kept": pa.array(texts, pa.string())})


def _by_block(blocks: DataFrame, known: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``make`` returns for each block's documents and what is known for it."""
    empty = pa.schema([(name, kind) for name, kind in _ARROW.items() if name in {c.split()[0] for c in schema.split(", ")}])

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        return make(docs, known).select(empty.names) if len(docs) else empty.empty_table()

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


_ARROW = {name: pa.int64() for name in ("doc_id", "n_words", "n_removed")} | {"kept": pa.string(), "hash": pa.int64(), "low": pa.int64(), "second": pa.int32(), "block": pa.int64(), "several": pa.bool_(), "clash": pa.bool_()}


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, and kept, the words that stay joined by one space.

    A word goes if a window of 13 words covers it whose words also start in a document with a smaller id; windows are judged on the input. Of equal texts the one with the
    smallest id is judged for all: every window of the others also starts there. A null or empty text has no word. Equal ids
    are no smaller than each other, so repeated rows stay alike; a row without an id neither loses words nor takes any from others. Ids must fit a long; other columns are never read.
    An empty table gives no row.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    facts = stored(rows.select("doc_id", "key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "texts")
    total = facts.agg(F.sum("bytes")).first()[0] or 0
    count = max(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.lit(count)).alias("block")
    blocks = rows.select("doc_id", "key", "text", block)
    alike = with_group_values(facts.where("doc_id is not null"), "digest", F.col("doc_id"), {"low": F.min("doc_id")}, {"first": F.min("low")})
    later = stored(alike.where("doc_id > first").select(block, "doc_id", "key").distinct(), "copies")
    discard(facts)

    def known(hashes: DataFrame | None = None) -> DataFrame:
        return later if hashes is None else later.unionByName(hashes, allowMissingColumns=True)

    none = later.withColumn("hash", F.lit(None).cast("long"))
    anchors = _by_block(blocks, none, block_anchors, "hash long, block long, several boolean")
    over = Window.partitionBy("hash")
    held = anchors.withColumns({"blocks": F.count("*").over(over), "within": F.bool_or("several").over(over)})
    shared = held.where("blocks > 1 or within").select("block", "hash")
    windows = _by_block(blocks, known(shared), block_windows, "hash long, low long, second int, block long, several boolean, clash boolean")
    firsts = windows.withColumn("first", F.min("low").over(Window.partitionBy("hash", "second")))
    repeated = firsts.where("first < low or several").select("block", "hash", "first", F.when(F.col("clash"), F.col("second")).alias("second"))
    return _by_block(blocks, known(repeated), block_texts, "doc_id long, n_words long, n_removed long, kept string")


def digests(rows: DataFrame) -> DataFrame:
    """The digest of the words that stay instead of the words."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

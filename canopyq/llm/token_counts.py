"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: token counts and character lengths as subtree sums. An edit
finds its place by descending the lengths, re-encodes the touched pre-tokens with a few more on either side, and goes on to the right only until a
pre-token boundary of old and new text coincides. Then the sums above the touched leaves are updated; the rest of the text is neither read nor copied.
A tree can be kept as two columns, from which later edits start.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.llm import kernels as K
from canopyq.llm.rows import in_small_batches
from canopyq.llm.tokens import ByteLevelEncoder, default_path, plain, split_byte_level

#: Pre-tokens on either side of what an edit may change that are encoded again: no pre-token looks further ahead.
CONTEXT = 2
#: So many pre-tokens in one leaf, after insertions, have the leaves laid out anew.
CROWDED = 64

Edit = tuple[int, int, str]


class CountTree:
    """Segment tree of one document: leaf i holds pre-token i's token count and length in characters."""

    def __init__(self, counts: np.ndarray, lengths: np.ndarray) -> None:
        self.size = 1 << max(0, int(len(counts) - 1).bit_length()) if len(counts) else 1
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[0, self.size : self.size + len(counts)] = counts
        self.sums[1, self.size : self.size + len(counts)] = lengths
        self._sum(0, self.size - 1)

    def _sum(self, first: int, last: int) -> None:
        """Brings the sums above leaves ``first`` to ``last`` up to date."""
        lo, hi = first + self.size, last + self.size
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            below = self.sums[:, 2 * lo : 2 * hi + 2]
            self.sums[:, lo : hi + 1] = below[:, ::2] + below[:, 1::2]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[0, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 1])

    def length(self, leaf: int) -> int:
        return int(self.sums[1, self.size + leaf])

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position``, and where the leaf begins."""
        node, begin, lengths = 1, 0, self.sums[1]
        while node < self.size:
            node *= 2
            if position - begin >= lengths[node]:
                begin += int(lengths[node])
                node += 1
        return node - self.size, begin

    def put(self, first: int, counts: np.ndarray, lengths: np.ndarray) -> None:
        """Sets leaves from ``first`` on."""
        at = slice(self.size + first, self.size + first + len(counts))
        self.sums[0, at], self.sums[1, at] = counts, lengths
        self._sum(first, first + len(counts) - 1)


class EditedDocument:
    """A text with its count tree; ``apply`` edits both. Leaves are parts of the original text until an edit rewrites them.

    ``count`` splits a text into pre-tokens: their token counts and lengths. ``reach`` is one less than the length of the longest special token, which text on
    both sides of an edit may complete.
    """

    def __init__(self, text: str, counts: np.ndarray, lengths: np.ndarray, count: Callable[[str], tuple[np.ndarray, np.ndarray]], reach: int) -> None:
        self.original, self.count, self.reach, self.recoded = text, count, reach, 0
        self._lay_out(counts, lengths)

    def _lay_out(self, counts: np.ndarray, lengths: np.ndarray) -> None:
        self.tree = CountTree(counts, lengths)
        self.leaves = max(1, len(counts))
        self.begin = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64), np.zeros(self.leaves - len(counts), np.int64)])
        self.rewritten: dict[int, str] = {}
        self.crowds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _leaf(self, leaf: int) -> str:
        return self.rewritten[leaf] if leaf in self.rewritten else self.original[self.begin[leaf] : self.begin[leaf + 1]]

    def _span(self, first: int, last: int) -> str:
        return "".join(self._leaf(i) for i in range(first, last + 1))

    @property
    def text(self) -> str:
        parts, at = [], 0
        for leaf in sorted(self.rewritten):
            parts += [self.original[self.begin[at] : self.begin[leaf]], self.rewritten[leaf]]
            at = leaf + 1
        return "".join([*parts, self.original[self.begin[at] :] if at < self.leaves else ""])

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts and lengths of the present pre-tokens, in order."""
        t, cuts = self.tree, [[], []]
        at = 0
        for leaf in [*sorted(self.crowds), self.leaves]:
            for k in (0, 1):
                cuts[k].append(t.sums[k, t.size + at : t.size + leaf])
                if leaf in self.crowds:
                    cuts[k].append(self.crowds[leaf][k])
            at = leaf + 1
        counts, lengths = (np.concatenate(c) for c in cuts)
        return counts[lengths > 0], lengths[lengths > 0]

    def apply(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters from ``start`` to ``end`` of the present text."""
        tree, n = self.tree, self.tree.n_chars
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        if n == 0:
            counts, lengths = self.count(replacement)
            self.recoded += len(replacement)
            self.original = replacement
            self._lay_out(counts, lengths)
            return
        first, left = tree.find(max(0, min(start, n - 1) - self.reach))
        for _ in range(CONTEXT):
            if left:
                first, left = tree.find(left - 1)
        last, at = tree.find(min(n - 1, max(start, end - 1) + self.reach))
        step = CONTEXT
        while True:
            for _ in range(step):
                right = at + tree.length(last)
                if right == n:
                    break
                last, at = tree.find(right)
            right = at + tree.length(last)
            old = self._span(first, last)
            region = old[: start - left] + replacement + old[end - left :]
            # The old boundary at ``right`` must be one of the new text too; what follows, as far as a special token or pre-token can look, shows it.
            tail, after = "", right
            while after < n and len(tail) < self.reach + 4:
                leaf, _ = tree.find(after)
                tail += self._leaf(leaf)
                after += tree.length(leaf)
            counts, lengths = self.count(region + tail)
            stops = np.cumsum(lengths)
            place = int(np.searchsorted(stops, len(region)))
            if right == n or not region or (place < len(stops) and stops[place] == len(region)):
                break
            step *= 2
        inside = stops <= len(region)
        self.recoded += len(region)
        self._rewrite(first, last, region, counts[inside], lengths[inside])

    def _rewrite(self, first: int, last: int, region: str, counts: np.ndarray, lengths: np.ndarray) -> None:
        """One pre-token a leaf from ``first`` to ``last``; what is more goes to the last of them, until it is crowded."""
        room = last - first + 1
        alone = min(len(counts), room - 1)
        new = np.zeros((2, room), np.int64)
        new[:, :alone] = counts[:alone], lengths[:alone]
        new[:, -1] = counts[alone:].sum(), lengths[alone:].sum()
        ends = np.cumsum(new[1])
        for k in range(room):
            self.rewritten[first + k] = region[ends[k] - new[1, k] : ends[k]]
            self.crowds.pop(first + k, None)
        self.tree.put(first, *new)
        if len(counts) - alone > 1:
            self.crowds[last] = counts[alone:], lengths[alone:]
        if len(counts) - alone > CROWDED:
            text, (counts, lengths) = self.text, self.state()
            self.original = text
            self._lay_out(counts, lengths)

    @property
    def n_tokens(self) -> int:
        return self.tree.n_tokens


class LeafSplitter:
    """Pre-tokens of whole texts, with token counts: by bytes for plain texts, by the library's splitter for others. A special token is a leaf of its own."""

    def __init__(self, path: str) -> None:
        self.encoder = ByteLevelEncoder(path)
        special = [t.content for t in self.encoder.tokenizer.get_added_tokens_decoder().values()]
        self.reach = max(map(len, special), default=1) - 1
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special = set(special)

    def leaves(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token count and length in characters of each pre-token, and the rows' offsets."""
        fast = plain(data, offsets)
        starts, ends = split_byte_level(data, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        chars = K.code_points(data)
        if fast.all():
            return self.encoder.table.counts(data, starts, ends), chars[ends] - chars[starts], np.searchsorted(starts, offsets)
        keep = fast[row]
        starts, ends, row = starts[keep], ends[keep], row[keep]
        counts, lengths = [self.encoder.table.counts(data, starts, ends)], [chars[ends] - chars[starts]]
        rows = [row]
        for i in np.flatnonzero(~fast).tolist():
            c, n = self._by_library(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            counts.append(c)
            lengths.append(n)
            rows.append(np.full(len(c), i))
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return np.concatenate(counts)[order], np.concatenate(lengths)[order], np.searchsorted(row[order], np.arange(len(offsets)))

    def _by_library(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                words.append(piece)
            elif piece:
                words += [piece[a:b] for _, (a, b) in self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        starts = ends - np.array([len(w) for w in raw], np.int64)
        counts = self.encoder.table.counts(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        return counts, np.array([len(w) for w in words], np.int64)

    def count(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and lengths of one text's pre-tokens."""
        raw = np.frombuffer(piece.encode(), np.uint8)
        return self.leaves(raw, np.array([0, len(raw)]))[:2]


#: Personal data that the registered query's edits take out: addresses of mail, of machines, telephone and card numbers.
_MAIL = r"(?P<mail>(?<![^\W\d])(?<!\.)[\w.]+@[\w.]+\w)"
_NUMBERS = r"(?P<address>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<card>\b\d{16}\b|\b\d{4}(?:[ -]\d{4}){3}\b)|(?P<phone>\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}\b|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b)"
_BOTH, _MAIL_ONLY, _NUMBERS_ONLY, _DIGIT = (re.compile(p) for p in (f"{_MAIL}|{_NUMBERS}", _MAIL, _NUMBERS, r"\d"))


def personal_data_edits(text: str) -> list[Edit]:
    """Edits that replace personal data by a placeholder of its kind. Mail needs an @ and all else a digit, so patterns that can't match aren't tried."""
    mail, number = "@" in text, _DIGIT.search(text) is not None
    if not mail and not number:
        return []
    pattern = _BOTH if mail and number else _MAIL_ONLY if mail else _NUMBERS_ONLY
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in pattern.finditer(text)]


def ordered_edits(given: list[dict | None] | None, n: int) -> list[Edit]:
    """Edits of a column in order of place within ``n`` characters.

    An edit that is null or has a null place is left out, a null replacement is empty. Places below 0 or beyond the text are moved to its ends. Where edits overlap, the one that
    begins first ends where the next begins.
    """
    clean = [(e["start"], e["end"], e["replacement"] or "") for e in given or [] if e is not None and e["start"] is not None and e["end"] is not None]
    clean = sorted((max(0, min(a, n)), max(0, min(max(a, b), n)), to) for a, b, to in clean)
    return [(a, min(b, clean[k + 1][0]) if k + 1 < len(clean) else b, to) for k, (a, b, to) in enumerate(clean)]


STATE = ("leaf_counts", "leaf_lengths")


def edited_token_counts(
    docs: DataFrame, edits: str | Callable[[str], list[Edit]] = personal_data_edits, tokenizer_path: str | None = None, text: str = "text", state: tuple[str, str] | None = None, keep: bool = False
) -> DataFrame:
    """Token counts of every whole text before and after its edits; one row for each row of the input.

    ``edits`` is a function of the text that returns ordered edits, or the name of a column of array<struct<start int, end int, replacement string>> as ``ordered_edits``
    takes it; places are characters of the original text. A null array means no edit.
    With ``keep`` the edited text and its tree, as ``leaf_counts`` and ``leaf_lengths``, are columns too; ``state`` names two such columns of the input, from which counting starts
    without splitting the text; a row whose state is null or of another length than its text is split.
    Null and empty texts count 0 tokens. Repeated rows give repeated results; other columns are never read; an empty table gives an empty result.
    """
    path = tokenizer_path or default_path("byte_bpe_50k.json")
    by_column = isinstance(edits, str)
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_recoded"]
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_recoded long"
    if keep:
        names += ["text", *STATE]
        schema += ", text string, leaf_counts array<int>, leaf_lengths array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = LeafSplitter(path)

        def known(batch: pa.RecordBatch, row: int, n: int) -> tuple[np.ndarray, np.ndarray] | None:
            counts, lengths = batch.column("c")[row].as_py(), batch.column("l")[row].as_py()
            if counts is None or lengths is None or len(counts) != len(lengths) or sum(lengths) != n:
                return None
            return np.array(counts, np.int64), np.array(lengths, np.int64)

        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column("t"))
            for a, b, part, at in K.chunks(data, offsets):
                if not state:
                    counts, lengths, bounds = splitter.leaves(part, at)
                rows = []
                for i in range(b - a):
                    content = part[at[i] : at[i + 1]].tobytes().decode()
                    todo = ordered_edits(batch.column("e")[a + i].as_py(), len(content)) if by_column else edits(content)
                    if state:
                        tree = known(batch, a + i, len(content)) or splitter.count(content)
                    else:
                        tree = counts[bounds[i] : bounds[i + 1]], lengths[bounds[i] : bounds[i + 1]]
                    before = int(tree[0].sum())
                    if not todo and not keep:
                        rows.append((before, 0, before, len(content), 0))
                        continue
                    document = EditedDocument(content, *tree, splitter.count, splitter.reach)
                    for start, end, replacement in reversed(todo):
                        document.apply(start, end, replacement)
                    row = (before, len(todo), document.n_tokens, document.tree.n_chars, document.recoded)
                    rows.append((*row, document.text, *(x.astype(np.int32) for x in document.state())) if keep else row)
                cols = list(zip(*rows, strict=True))
                out = [pa.array(c, pa.int64()) for c in cols[:5]]
                if keep:
                    out += [pa.array(cols[5], pa.string()), *(pa.array(c, pa.list_(pa.int32())) for c in cols[6:])]
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(a, b - a), *out], names)

    columns = [docs["doc_id"].cast("long").alias("i"), docs[text].cast("string").alias("t")] + ([docs[edits].alias("e")] if by_column else [])
    columns += [docs[c].cast("array<int>").alias(k) for c, k in zip(state, "cl", strict=True)] if state else []
    return in_small_batches(docs.select(*columns)).mapInArrow(run, schema)


def token_state(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, text, n_tokens and the count tree of every whole text, for ``edited_token_counts`` to start from."""
    none = docs.select(docs["doc_id"].alias("doc_id"), docs[text].alias("text"), F.lit(None).cast("array<struct<start:int,end:int,replacement:string>>").alias("e"))
    return edited_token_counts(none, "e", tokenizer_path, keep=True).select("doc_id", "text", "n_tokens", *STATE)

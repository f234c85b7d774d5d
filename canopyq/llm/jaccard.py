"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams. MinHash bands bring candidates together; within a bucket, MinHash values are compared a chunk at
a time, and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls below
the tolerance. What survives spans candidate components; inside each component all pairs are pruned the same way and the rest verified on the full
n-gram sets.

No step emits pairs. A bucket or component of bounded size is one unit of work, which returns a spanning forest of its links and the number of links of each text.
A larger one is dealt into blocks. Blocks are contracted by themselves first; only then do pairs of blocks meet, and they send one edge for each two local
roots that they join. In buckets, texts that already hang together don't meet again, so a bucket of near copies never has its rows copied.
Values of whole buckets and components reach their rows over salts, so no key has a task to itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.llm import kernels as K
from canopyq.llm.rows import in_small_batches
from canopyq.operators.graph import connected_components
from canopyq.plans.salted import with_few, with_group_values
from canopyq.plans.storage import discard, stored


@dataclass(frozen=True)
class JoinRules:
    """Parameters of the join. ``bands`` x ``rows`` MinHash values: at similarity 0.8 a pair shares no bucket once in 300,000 times.

    ``block`` texts are compared by MinHash in one unit, ``verify_block`` by n-grams, or fewer where their n-grams take more than ``verify_bytes``.
    """

    width: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    chunk: int = 16
    tolerance: float = 1e-7
    block: int = 4096
    verify_block: int = 512
    verify_bytes: int = 1 << 25
    #: Up to so many candidate texts their keys (16 bytes) are broadcast to pick the texts; beyond, the texts are joined by a shuffle.
    broadcast_texts: int = 400_000


def posterior(matches: int, compared: int, threshold: float, steps: int = 4000) -> float:
    """Probability that the similarity is at least ``threshold`` given ``matches`` of ``compared`` equal values and a uniform prior."""
    x = (np.arange(steps) + 0.5) / steps
    log_density = matches * np.log(x) + (compared - matches) * np.log1p(-x)
    density = np.exp(log_density - log_density.max())
    return float(density[x >= threshold].sum() / density.sum())


def least_matches(rules: JoinRules) -> list[tuple[int, int]]:
    """For each chunk: values compared so far, and the fewest matches with which a pair goes on."""
    out = []
    for compared in range(rules.chunk, rules.bands * rules.rows + 1, rules.chunk):
        fewest = next(m for m in range(compared + 1) if m == compared or posterior(m, compared, rules.threshold) >= rules.tolerance)
        out.append((compared, fewest))
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams and the rows' offsets; a text of fewer words has one n-gram of them all."""
    starts, ends, first = K.runs(K.ALNUM[data], offsets)
    h = K.Prefix(data, K.FOLDED_VALUES).span(starts, ends)
    count = np.diff(first)
    windows = K.window_hashes(h, width)
    full = np.maximum(count - width + 1, 0)
    row, place = K.spread(np.where(count > 0, np.maximum(full, 1), 0))
    out = np.zeros(len(row), np.uint64)
    whole = full[row] > 0
    out[whole] = windows[first[row[whole]] + place[whole]]
    for i in np.flatnonzero((count > 0) & (full == 0)):
        own = h[first[i] : first[i + 1]]
        out[np.searchsorted(row, i)] = K.window_hashes(own, len(own))[0]
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(count)))])


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(80))
    return random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (32 bits) of each row that has an n-gram; zeros for the others."""
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        cuts = offsets[:-1][filled]
        for i, (a, b) in enumerate(zip(*_permutations(n), strict=True)):
            out[filled, i] = np.minimum.reduceat(values * a + b, cuts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray, rules: JoinRules) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    with np.errstate(over="ignore"):
        key = np.zeros((len(signature), rules.bands), np.uint64) + K.mix(np.arange(1, rules.bands + 1, dtype=np.uint64))
        parts = signature.reshape(len(signature), rules.bands, rules.rows).astype(np.uint64)
        for k in range(rules.rows):
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, k])
    return key.astype(np.int64)


class Pruner:
    """Incremental comparison of MinHash values under the posterior bound."""

    def __init__(self, rules: JoinRules) -> None:
        self.steps = least_matches(rules)

    def alive(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which rows of ``right`` stay candidates of ``left`` (one row, or row by row)."""
        rows, matches, begin = np.arange(len(right)), np.zeros(len(right), np.int64), 0
        for compared, fewest in self.steps:
            one = left[begin:compared] if left.ndim == 1 else left[rows, begin:compared]
            matches = matches + (right[rows, begin:compared] == one).sum(1)
            keep = matches >= fewest
            rows, matches, begin = rows[keep], matches[keep], compared
            if not len(rows):
                break
        out = np.zeros(len(right), bool)
        out[rows] = True
        return out


class Forest:
    """Disjoint sets of small integers, given by a first label of each; the smallest member of a set is its root."""

    def __init__(self, names: np.ndarray) -> None:
        _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        self.label = first[inverse]
        self.roots = self.label.copy()

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.label[others], self.label[a]))
        if len(roots) > 1:
            self.label[np.isin(self.label, roots[1:])] = roots[0]

    def unions(self) -> tuple[np.ndarray, np.ndarray]:
        """First roots that have a new root, and it."""
        own = np.unique(self.roots)
        own = own[self.label[own] != own]
        return own, self.label[own]


def _signed(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """Key, signature and bucket keys of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(2))
            for a, b, part, at in K.chunks(data, offsets):
                values, cuts = shingles(part, at, rules.width)
                signature = minhash(values, cuts, rules.bands * rules.rows)
                full = np.diff(cuts) > 0
                keys = band_keys(signature[full], rules)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * rules.bands)]), pa.int32()), pa.array(keys.ravel()))
                low = signature.astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([s.tobytes() for s in low]), bands], ["node", "doc_id", "signature", "bands"])

    return in_small_batches(docs.select("node", "doc_id", "text")).mapInArrow(K.given_back(run), "node binary, doc_id long, signature binary, bands array<long>")


def _one_block(members: DataFrame, key: str, parts: Column) -> DataFrame:
    """Each row in the unit of its own block, (i, i), of ``parts`` blocks of its group."""
    dealt = members.withColumn("i", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("j", F.col("i")).withColumn("part", F.col("i"))
    return dealt.repartition(key, "i").sortWithinPartitions(key, "i", "j", "node")


def _crossed_blocks(members: DataFrame, key: str, size: int) -> DataFrame:
    """A copy of each row for each pair of blocks to which it belongs and whose rows may still join.

    Rows have ``n``, the group's size, and ``most``, the size of its largest set of rows that hang together (``in_most``): blocks within that set never meet, so copies
    of the set's rows grow with the rest of the group alone.
    """
    large, rest = F.ceil(F.col("most") / size), F.ceil((F.col("n") - F.col("most")) / size)
    dealt = members.withColumns({"large": large.cast("int"), "rest": rest.cast("int")}).where("rest > 0")
    own = F.when(F.col("in_most"), F.pmod(F.xxhash64("node"), F.col("large"))).otherwise(F.col("large") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    others = F.sequence(F.when(F.col("in_most"), F.col("large")).otherwise(F.lit(0)), F.col("large") + F.col("rest") - 1)
    dealt = dealt.withColumn("part", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("large", "rest", "other", "n", "most", "in_most")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal first ``n_keys`` columns; rows come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _last_group(batch, n_keys)
        if cut or (held and not _same_key(held[-1], batch, n_keys)):
            table = pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            if table.num_rows:
                yield table
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _row_key(batch: pa.RecordBatch, row: int, n_keys: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in range(n_keys))


def _same_key(a: pa.RecordBatch, b: pa.RecordBatch, n_keys: int) -> bool:
    return _row_key(a, a.num_rows - 1, n_keys) == _row_key(b, 0, n_keys)


def _last_group(batch: pa.RecordBatch, n_keys: int) -> int:
    """First row of the batch's last group."""
    lo, hi, last = 0, batch.num_rows - 1, _row_key(batch, batch.num_rows - 1, n_keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if _row_key(batch, mid, n_keys) == last:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _bounds(table: pa.Table, n_keys: int) -> np.ndarray:
    """Offsets of the groups of a table."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for c in range(n_keys):
        column = table.column(c).combine_chunks()
        if pa.types.is_binary(column.type):
            values = np.frombuffer(b"".join(column.to_pylist()), np.dtype((np.void, 16)))
        else:
            values = column.to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1)


def _sides(part: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of block i and of block j; the same rows twice for a block by itself."""
    left = np.flatnonzero(part == i)
    return left, left if i == j else np.flatnonzero(part == j)


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], ["src", "dst"])


def _candidates(members: DataFrame, rules: JoinRules) -> DataFrame:
    """Unions, by pairs that survive, of the rows of each unit; rows with the same ``label`` hang together already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruner = Pruner(rules)
        for table in _groups(batches, 3):
            bounds = _bounds(table, 3)
            signature, labels = _matrix(table.column("signature")), table.column("label").to_pylist()
            i, part = (table.column(c).to_numpy() for c in ("i", "part"))
            j = table.column("j").to_numpy()
            size = np.diff(bounds)
            first = bounds[:-1][size == 2]
            first = first[(i[first] == j[first]) | (part[first] != part[first + 1])]
            edges = {(labels[a], labels[a + 1]) for a in first[pruner.alive(signature[first], signature[first + 1])].tolist() if labels[a] != labels[a + 1]}
            for g in np.flatnonzero(size > 2):
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                mine, forest = signature[lo:hi], Forest(np.array(labels[lo:hi], "S16"))
                left, right = _sides(part[lo:hi], i[lo], j[lo])
                for a in left.tolist():
                    others = right[forest.label[right] != forest.label[a]]
                    if len(others):
                        others = others[pruner.alive(mine[a], mine[others])]
                        if len(others):
                            forest.join(a, others)
                for b, root in zip(*(x.tolist() for x in forest.unions()), strict=True):
                    edges.add((labels[lo + root], labels[lo + b]))
            if edges:
                yield _edges(sorted(edges))

    return members.select("key", "i", "j", "part", "label", "signature").mapInArrow(K.given_back(run), "src binary, dst binary")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, limit: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of incidence matrices over slices of the values."""
    lens = np.array([len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), lens)
    shared = np.bincount(value) > 1
    number = np.cumsum(shared) - 1
    row, value = row[shared[value]], number[value[shared[value]]]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    out, width = np.zeros((len(left), len(right)), np.float64), max(1, limit // len(sets))
    for begin in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(value, [begin, begin + width])
        incidence = np.zeros((len(sets), width), np.float32)
        incidence[row[lo:hi], value[lo:hi] - begin] = 1
        out += incidence[left] @ incidence[right].T
    return out


def _verified(members: DataFrame, rules: JoinRules) -> DataFrame:
    """For each text of a unit its links there, and the unions of labels that they bring, as (root, other) of rows without a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruner = Pruner(rules)
        for table in _groups(batches, 3):
            bounds = _bounds(table, 3)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                unit = table.slice(lo, hi - lo)
                nodes, labels, part = unit.column("node").to_pylist(), unit.column("label").to_pylist(), unit.column("part").to_numpy()
                i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
                left, right = _sides(part, i, j)
                if not len(left) or not len(right):
                    continue
                signature = _matrix(unit.column("signature"))
                sets = [np.frombuffer(s, np.uint64) for s in unit.column("grams").to_pylist()]
                alive = np.stack([pruner.alive(signature[a], signature[right]) for a in left])
                if i == j:
                    alive &= left[:, None] != right[None, :]
                both = _intersections(sets, left, right)
                size = np.array([len(s) for s in sets])
                linked = alive & (both >= rules.threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9)
                links, forest = np.zeros(hi - lo, np.int64), Forest(np.array(labels, "S16"))
                links[left] += linked.sum(1)
                if i != j:
                    links[right] += linked.sum(0)
                for a, row in zip(left.tolist(), linked, strict=True):
                    if row.any():
                        forest.join(a, right[row])
                some, (own, root) = np.flatnonzero(links), forest.unions()
                if len(some):
                    node = [nodes[k] for k in some] + [labels[k] for k in own]
                    other = [None] * len(some) + [labels[k] for k in root]
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([*links[some].tolist(), *[None] * len(own)], pa.int64()), pa.array(other, pa.binary())], ["node", "links", "other"])

    return members.select("component", "i", "j", "part", "node", "label", "signature", "grams").mapInArrow(K.given_back(run), "node binary, links long, other binary")


def _gram_sets(docs: DataFrame, width: int) -> DataFrame:
    """The n-gram set of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(1))
            for a, b, part, at in K.chunks(data, offsets):
                values, cuts = shingles(part, at, width)
                sets = [np.unique(values[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["node", "grams"])

    return in_small_batches(docs.select("node", "text")).mapInArrow(K.given_back(run), "node binary, grams binary")


def _hanging(rows: DataFrame, key: str) -> DataFrame:
    """Adds to rows with ``label`` the size ``n`` of their group of ``key``, the size ``most`` of its largest set with one label, and whether a row is ``in_most``.

    For large groups only: their few figures are copied to salts.
    """
    sets = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"))
    whole = sets.groupBy(key).agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
    few = whole.select(key, "n", F.col("top.c").alias("most"), F.col("top.label").alias("first"))
    return with_few(rows, few, key, F.col("node")).withColumn("in_most", F.col("label") == F.col("first")).drop("first")


def _candidate_components(nodes: DataFrame, rules: JoinRules) -> DataFrame:
    """(node, component) of texts that pairs in buckets join, stored."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    count = {"n": F.count(F.lit(1))}
    shared = stored(with_group_values(keyed, "key", F.col("node"), count, {"n": F.sum("n")}, "n > 1"), "buckets")
    signed = shared.join(nodes.select("node", "signature"), "node")
    units = _one_block(signed.withColumn("label", F.col("node")), "key", F.ceil(F.col("n") / rules.block))
    first = connected_components(_candidates(units, rules))
    hot = signed.where(F.col("n") > rules.block).drop("n")
    if hot.isEmpty():
        discard(shared)
        return first
    named = hot.join(first, "node", "left").select("key", "node", "signature", F.coalesce("component", "node").alias("label"))
    second = connected_components(_candidates(_crossed_blocks(_hanging(named, "key"), "key", rules.block), rules))
    discard(shared)
    return _composed(first, second, "candidates")


def _composed(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """Components of nodes after ``second`` joined components of ``first``, or nodes that had none; stored, and the two discarded."""
    onto = second.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = first.join(onto, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = second.join(first, "node", "left_anti")
    out = stored(old.unionByName(new), name)
    discard(first, second)
    return out


def jaccard_join(docs: DataFrame, rules: JoinRules = JoinRules(), text: str = "text") -> DataFrame:
    """Similar texts among all documents: one row for each row of the input. Its searches run during the call; the result reads stored tables.

    ``copy_id`` is the smallest doc_id with exactly this text, ``n_links`` the number of different texts whose similarity reaches the
    threshold, ``class_id`` the smallest doc_id among all texts that links join. Null is as the empty text; texts without a word have no n-gram and no links,
    and only equal ones share a class. Repeated rows are copies of each other. Ids may be null or repeat over different texts: texts are told apart by
    their hash. Other columns are never read; an empty table gives an empty result.
    """
    rows = _with_node(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), F.col("text"))
    return _attached(rows.select("node", "doc_id"), _classes(rows, rules)).select("doc_id", "copy_id", "class_id", "n_links")


def _with_node(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``node``, the hash by which texts are told apart."""
    return rows.withColumn("node", F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _attached(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Joins rows, many of which may be copies of one text, with their text's row in ``classes``."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    present = dealt.select("node", "_salt").distinct().join(classes, "node")
    return dealt.join(present, ["node", "_salt"]).drop("_salt")


def _classes(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """(node, copy_id, class_id, is_head, n_links) of each different text of ``rows`` (node, doc_id, text), stored.

    The head of a class is its text with the smallest doc_id and, among those, the smallest hash; texts without any id come last.
    """
    texts = rows.withColumn("text", F.coalesce("text", F.lit("")))
    signed = _signed(texts, rules)
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")), "signatures")
    components = _candidate_components(nodes, rules)
    wanted = components.select("node")
    few = wanted.count() <= rules.broadcast_texts
    chosen_texts = texts.select("node", "text").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    grams = _gram_sets(chosen_texts, rules.width).groupBy("node").agg(F.any_value("grams").alias("grams"))
    chosen = components.join(nodes.select("node", "signature"), "node").join(grams, "node")
    sums = {"n": F.count(F.lit(1)), "bytes": F.sum(F.octet_length("grams"))}
    sized = with_group_values(chosen, "component", F.col("node"), sums, {c: F.sum(c) for c in sums}).withColumn("label", F.col("node"))
    parts = F.greatest(F.ceil(F.col("n") / rules.verify_block), F.ceil(F.col("bytes") / rules.verify_bytes)).cast("int")
    sized = stored(sized.withColumn("parts", parts).drop("n", "bytes"), "chosen")
    verified = stored(_verified(_one_block(sized, "component", F.col("parts")), rules), "links")
    classes = connected_components(verified.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    links = [verified]
    large = sized.where("parts > 1")
    if not large.isEmpty():
        named = large.drop("label").join(classes.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        dealt = named.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.where("part <> other").withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
        crossed = stored(_verified(dealt, rules).groupBy("node", "other").agg(F.sum("links").alias("links")), "crossed")
        second = connected_components(crossed.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
        classes = _composed(classes, second, "classes")
        links.append(crossed)
    counts = [t.where("other is null").select("node", "links") for t in links]
    total = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    known = nodes.select("node", "copy_id").join(classes, "node", "left").join(total.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = {"class_id": F.min("copy_id"), "head": F.min(F.struct(F.col("copy_id").isNull().alias("no_id"), "copy_id", "node"))}
    known = with_group_values(known, "component", F.col("node"), least, {c: F.min(c) for c in least})
    out = stored(known.select("node", "copy_id", "class_id", (F.col("node") == F.col("head.node")).alias("is_head"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    discard(nodes, components, sized, classes, *links)
    return out


def one_of_each_class(docs: DataFrame, rules: JoinRules = JoinRules(), text: str = "text") -> DataFrame:
    """Keeps one row of each class: with its smallest doc_id, among those with the smallest text hash; rows without an id only where no row of the class has one.

    Classes are told apart by their texts, so one id on texts of two classes loses neither. Of rows equal in id and text one stays, whichever. Null and empty texts are one class.
    """
    whole = F.struct(*(docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(docs.columns)))
    named = _with_node(docs.select(whole.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), F.col("text"))
    classes = _classes(named.select("node", "doc_id", "text"), rules).where("is_head").select("node", "copy_id")
    heads = named.drop("text").join(classes, "node").where(F.col("doc_id").eqNullSafe(F.col("copy_id")))
    return heads.groupBy("node").agg(F.first("row").alias("row")).select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(docs.columns)))

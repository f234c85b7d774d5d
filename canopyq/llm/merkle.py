"""A Merkle manifest of a dataset, with a version of the tree for each tampered leaf.

Leaves of a group, in order of their keys, are cut into aligned blocks of 1,024; a block's subtree is built in one task, and block roots are the leaves of the next stage,
until each group has one root. Group roots, in order of their groups, form one more tree by the same stages. On the way down each block gets its path: the
siblings of its root at every level above. A block's task then holds a persistent tree of its subtree and its path: a changed leaf copies its ancestors
up to the root and shares every other node, so versions are made block by block, at all levels, without any task seeing more than a block.
Leaf places come from a range-sorted table and counts of its parts, so no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.plans.storage import discard, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block.
BITS = 10
_LEFT, _RIGHT, _ALONE = "<", ">", ""


def digest(*parts: str) -> str:
    """Lower-case hexadecimal sha256 of strings, one after another."""
    return sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


class PersistentTree:
    """A tree of pairs under a path to the root; nodes are only ever added.

    ``index`` bits tell which child leads down: bit k at level k of the subtree. Path entries begin with the side of the sibling, or are empty where a node has none.
    """

    def __init__(self, leaves: Sequence[str], depth: int, path: Sequence[str] = ()) -> None:
        self.digests, self.first, self.second = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        level = list(range(len(leaves)))
        for _ in range(depth):
            level = [self._node(*level[i : i + 2]) for i in range(0, len(level), 2)]
        (self.root,) = level
        self.depth, self.path = depth, path
        for entry in path:
            if entry == _ALONE:
                self.root = self._node(self.root)
            else:
                sibling = self._leaf(entry[1:])
                self.root = self._node(sibling, self.root) if entry[0] == _LEFT else self._node(self.root, sibling)

    def _leaf(self, value: str) -> int:
        self.digests.append(value)
        self.first.append(-1)
        self.second.append(-1)
        return len(self.digests) - 1

    def _node(self, first: int, second: int = -1) -> int:
        self.digests.append(digest(self.digests[first], self.digests[second]) if second >= 0 else digest(self.digests[first]))
        self.first.append(first)
        self.second.append(second)
        return len(self.digests) - 1

    def descent(self, index: int, root: int | None = None) -> list[tuple[int, bool]]:
        """Nodes from the root to the parent of a leaf, with whether the way goes on to the second child."""
        node, out = self.root if root is None else root, []
        turns = [entry[:1] == _LEFT for entry in reversed(self.path)] + [bool(index >> k & 1) for k in reversed(range(self.depth))]
        for turn in turns:
            out.append((node, turn))
            node = self.second[node] if turn else self.first[node]
        return out

    def proof(self, index: int) -> list[str]:
        """Sibling entries from the leaf to the root."""
        out = []
        for node, turn in reversed(self.descent(index)):
            if turn:
                out.append(_LEFT + self.digests[self.first[node]])
            else:
                out.append(_RIGHT + self.digests[self.second[node]] if self.second[node] >= 0 else _ALONE)
        return out

    def updated(self, index: int, value: str, root: int | None = None) -> int:
        """The root of a version in which one leaf differs: its ancestors are copied, all other nodes shared."""
        node = self._leaf(value)
        for old, turn in reversed(self.descent(index, root)):
            node = self._node(self.first[old], node) if turn else self._node(node, self.second[old])
        return node

    def forget(self, size: int) -> None:
        """Drops nodes after the first ``size``: versions that nothing reads any more."""
        del self.digests[size:], self.first[size:], self.second[size:]


def encoded(value: Column) -> Column:
    """A dash for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, each row's place in its group by ``order``, and ``n``, the group's rows; stored.

    Rows are sorted by range and stored with their place in their part; counts of parts then give the places before each. A large group has many parts.
    """
    keys = [group, *order]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    parts = placed.groupBy("part", group).agg(F.min("at").alias("start"), F.count("*").alias("size"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", group, (before - F.col("start")).alias("shift"), F.sum("size").over(whole).alias("n"))
    out = stored(placed.join(parts, ["part", group]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift"), name)
    discard(placed)
    return out


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", BITS))


def parents(nodes: DataFrame) -> DataFrame:
    """Roots of the aligned blocks of nodes (g, idx, n, digest): the same columns one stage higher."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table["n"][0].as_py()
        tree = PersistentTree(table["digest"].to_pylist(), min(BITS, levels(n)))
        return pa.table({"g": table["g"].slice(0, 1), "idx": table["block"].slice(0, 1), "n": pa.array([-(-n >> BITS) if n > 1 else 1], pa.int64()), "digest": [tree.digests[tree.root]]})

    return blocked(nodes.select("g", "idx", "n", "digest")).groupBy("g", "block").applyInArrow(build, "g string, idx long, n long, digest string")


def paths_below(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (g, idx, path) of nodes, from the paths of their blocks' roots."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        tree = PersistentTree(left["digest"].to_pylist(), min(BITS, levels(left["n"][0].as_py())), right["path"][0].as_py())
        return pa.table({"g": left["g"], "idx": left["idx"], "path": pa.array([tree.proof(i) for i in range(len(left))], pa.list_(pa.string()))})

    below = blocked(nodes.select("g", "idx", "n", "digest")).groupBy("g", "block")
    return below.cogroup(paths.withColumnRenamed("idx", "block").groupBy("g", "block")).applyInArrow(extend, "g string, idx long, path array<string>")


def stages(leaves: DataFrame) -> list[DataFrame]:
    """Leaves and the block roots of every stage up to one root a group."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while True:
        out.append(stored(parents(out[-1]), "merkle-blocks"))
        most = -(-most >> BITS)
        if most <= 1:
            return out


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", changes: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof (array of siblings' digests, from the leaf up), version_root, and copied, the nodes that the version copied.

    A leaf is the digest of the fields, each with its length. ``changes`` gives other values of fields, by which a version's leaf is made; a row whose leaf stays has the root itself.
    Leaves of a group ascend by key, null keys first; equal keys are ordered by leaf, so repeated rows give the same tree in any order of the input.
    Null groups are one group, the first. An empty table gives no row. Fields may have any type that casts to string; columns that aren't fields are never read.
    """
    value = lambda c: docs[f"`{c}`"]
    changed = {**{f: value(f) for f in fields}, **(changes or {})}
    g = F.coalesce(F.concat(F.lit("="), value(group).cast("string")), F.lit(""))  # orders as the group by bytes, null first
    leaf = leaf_digest([value(f) for f in fields])
    touched = F.lit(False)
    for f in changes or {}:
        touched |= ~value(f).eqNullSafe(changed[f])
    rows = docs.select(g.alias("g"), value(key).alias("key"), leaf.alias("digest"), F.when(touched, leaf_digest([changed[f] for f in fields])).alias("other"))
    hashed = stored(rows, "merkle-leaves")  # texts are read once, though sorting samples its input first
    leaves = ranked(hashed, "g", ["key", "digest"], "merkle-sorted")
    discard(hashed)
    tree = stages(leaves)
    subroots = tree[-1].select("g", "digest")
    crowns = stages(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "g", ["name"], "merkle-groups"))

    top = crowns[-1].select("g", "idx", F.array().cast("array<string>").alias("path"))
    for below in reversed(crowns[:-1]):
        top = paths_below(below, top)
    named = crowns[0].select("idx", F.col("name").alias("g")).join(top.select("idx", "path"), "idx")
    path = named.select("g", F.lit(0).cast("long").alias("idx"), "path")
    for below in reversed(tree[1:-1]):
        path = paths_below(below, path)

    def versions(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        height, digests = levels(left["n"][0].as_py()), left["digest"].to_pylist()
        tree = PersistentTree(digests, min(BITS, height), right["path"][0].as_py())
        size, root = len(tree.digests), tree.digests[tree.root]
        subroot = tree.digests[tree.descent(0)[-height][0]] if height else digests[0]
        found = []
        for i, (old, new) in enumerate(zip(digests, left["other"].to_pylist(), strict=True)):
            version = tree.updated(i, new or old)
            found.append((tree.digests[version], len(tree.digests) - size if new else 0))
            tree.forget(size)
        proofs = [[entry[1:] for entry in tree.proof(i) if entry] for i in range(len(digests))]
        return pa.table({"doc_id": left["key"], "leaf": left["digest"], "subroot": pa.array([subroot] * len(digests)), "root": pa.array([root] * len(digests)), "proof": pa.array(proofs, pa.list_(pa.string())), "version_root": pa.array([v for v, _ in found], pa.string()), "copied": pa.array([c for _, c in found], pa.int32())})

    kind = docs.schema[key].dataType.simpleString()
    below = blocked(leaves).groupBy("g", "block").cogroup(path.withColumnRenamed("idx", "block").groupBy("g", "block"))
    return below.applyInArrow(versions, f"doc_id {kind}, leaf string, subroot string, root string, proof array<string>, version_root string, copied int")


def digests(rows: DataFrame) -> DataFrame:
    """The digest of each proof instead of its entries, and whether the version's root is the root."""
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.col("version_root").alias("folded_root"), (F.col("version_root") == F.col("root")).alias("verified"))

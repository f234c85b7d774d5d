"""k nearest neighbours over a pyramid of occupied cells.

Cells halve from one box around all rows; only cells that hold rows exist. A cell of more than a few hundred rows has children, others are leaves. The asking rows form blocks, leaves
of a pyramid of their own, and a block goes down the other side's pyramid level by level: the cells it keeps are those that begin no farther away than k rows certainly end. So what a
block meets follows how dense its own surroundings are: a cluster far away is one cell until it is known to be too far, and rows in the void reach out over
empty space without meeting more than a few cells. Each block then measures its rows against those of the leaves that are left, in one task's arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from canopyq.plans.storage import again, discard, stored

#: Rows of a leaf, and of a block.
LEAF_ROWS = 512
#: Rows of a tree that one task takes as a whole, and rows of its parts.
WHOLE_ROWS, _PART_ROWS = 1 << 18, 48
#: Distances held at once.
_DISTANCES = 1 << 22

#: What is made of a block's answer: its rows, the others' rows, places of the k nearest among the others (-1: none) and distances.
Finish = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table]


def _axes(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def placed_rows(df: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """Rows whose coordinates are all there and finite."""
    for c in coordinates:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    return df


def _prepared(df: DataFrame, coordinates: Sequence[str], by: str | None, key: str, more: Sequence[str]) -> DataFrame:
    """Group, key, coordinates c0, c1, ... as doubles; rows with a missing coordinate or group are left out."""
    axes = [F.col(c).cast("double").alias(a) for c, a in zip(coordinates, _axes(len(coordinates)), strict=True)]
    rows = df.select((F.col(by) if by else F.lit(0)).alias("g"), F.col(key).alias("key"), *axes, *more)
    return placed_rows(rows, _axes(len(coordinates))).where("g is not null")


class Pyramid:
    """Counts and boxes of the occupied cells of rows (g, key, c0, ...), and each row's leaf."""

    def __init__(self, rows: DataFrame, origin: list[float], side: float, levels: int, leaf_rows: int) -> None:
        axes = _axes(len(origin))
        cell = [F.least(F.floor((F.col(a) - o) / side * 2**levels), F.lit(2**levels - 1)).alias(f"i{k}") for k, (a, o) in enumerate(zip(axes, origin, strict=True))]
        ids = [f"i{k}" for k in range(len(axes))]
        placed = rows.select("*", *cell)
        lows, highs = [F.min(a).alias(f"lo{k}") for k, a in enumerate(axes)], [F.max(a).alias(f"hi{k}") for k, a in enumerate(axes)]
        base = placed.groupBy("g", *ids).agg(F.count("*").alias("n"), *lows, *highs)
        each = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        up = [F.expr(f"shiftright({i}, {levels} - level)").alias(i) for i in ids]
        boxes = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(len(axes))] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(len(axes))]
        self.cells = stored(each.select("g", "level", *up, "n", *(f"{e}{k}" for e in ("lo", "hi") for k in range(len(axes)))).groupBy("g", "level", *ids).agg(F.sum("n").alias("n"), *boxes), "cells")
        self.ids, self.levels = ids, levels
        own = F.concat_ws("/", F.col("g").cast("string"), "level", *ids).alias("cell")
        parent = F.when(F.col("level") > 0, F.concat_ws("/", F.col("g").cast("string"), F.col("level") - 1, *(F.shiftright(i, 1) for i in ids))).alias("parent")
        large = self.cells.where((F.col("n") > leaf_rows) & (F.col("level") < levels)).select(own)
        named = self.cells.select("*", own, parent)
        inside = named.where("level = 0").unionByName(named.where("level > 0").join(large.withColumnRenamed("cell", "parent"), "parent", "left_semi").select(named.columns))
        self.nodes = stored(inside.select("*", ((F.col("n") <= leaf_rows) | (F.col("level") == levels)).alias("leaf")), "nodes")
        discard(self.cells)
        leaves = self.nodes.where("leaf").select("cell", "level")
        asked = base.select("g", *ids).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select("g", *ids, "level", F.concat_ws("/", F.col("g").cast("string"), "level", *(F.expr(f"shiftright({i}, {levels} - level)") for i in ids)).alias("cell"))
        home = asked.join(leaves, ["cell", "level"]).select("g", *ids, F.col("cell").alias("leaf"))
        self.rows = stored(placed.join(home, ["g", *ids]).drop(*ids), "leaf-rows")

    def again(self) -> Pyramid:
        """The same pyramid as the other side of a join."""
        other = copy(self)
        other.nodes, other.rows = again(self.nodes), again(self.rows)
        return other

    def discard(self) -> None:
        discard(self.nodes, self.rows)


def _gaps(dims: int) -> tuple[Column, Column]:
    """Squares of the least and the largest distance between a block's box and a cell's."""
    near, far = F.lit(0.0), F.lit(0.0)
    for d in range(dims):
        gap = F.greatest(F.col(f"lo{d}") - F.col(f"bhi{d}"), F.col(f"blo{d}") - F.col(f"hi{d}"), F.lit(0.0))
        wide = F.greatest(F.col(f"hi{d}") - F.col(f"blo{d}"), F.col(f"bhi{d}") - F.col(f"lo{d}"))
        near, far = near + gap * gap, far + wide * wide
    return near, far


def _pyramids(ours: DataFrame, theirs: DataFrame, dims: int, leaf_rows: int) -> tuple[Pyramid, Pyramid] | None:
    """Pyramids of both sides over one box, one pyramid if they are the same rows; None without rows."""
    both = ours.select(*_axes(dims)) if ours is theirs else ours.select(*_axes(dims)).unionByName(theirs.select(*_axes(dims)))
    ends = both.agg(F.count("*"), *(f(a) for a in _axes(dims) for f in (F.min, F.max))).first()
    if not ends[0]:
        return None
    origin = [ends[1 + 2 * d] for d in range(dims)]
    side = max(max(ends[2 + 2 * d] - ends[1 + 2 * d] for d in range(dims)) * (1 + 1e-9), 1e-9)
    levels = min(48 // dims + 4, math.ceil(math.log2(max(2, ends[0] * 16 / leaf_rows)) / dims) + 8)
    own = Pyramid(ours, origin, side, levels, leaf_rows)
    return own, own.again() if ours is theirs else Pyramid(theirs, origin, side, levels, leaf_rows)


def _reach(cells: DataFrame, dims: int, k: int) -> DataFrame:
    """Pairs (block, cell) to keep: cells no farther from the block's box than k rows reach for sure. ``cells`` has block and cell columns with boxes."""
    near, far = _gaps(dims)
    pairs = cells.withColumns({"near": near * (1 - 1e-12), "far": far * (1 + 1e-12)})
    order = Window.partitionBy("block").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    reached = pairs.withColumn("sofar", F.sum("n").over(order))
    limit = F.min(F.when(F.col("sofar") >= k, F.col("far"))).over(Window.partitionBy("block"))
    return reached.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("near") <= F.col("limit"))).drop("near", "far", "sofar", "limit")


def _wanted(left: Pyramid, right: Pyramid, dims: int, k: int, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Leaves of the right side that each block of the left side must measure, (block, leaf), and the left rows with their blocks.

    A block whose box is too wide to tell more than ``most`` cells apart goes on as its single rows, each a block.
    """
    axes, box = _axes(dims), [f"b{e}{d}" for e in ("lo", "hi") for d in range(dims)]
    blocks = left.nodes.where("leaf").select("g", F.col("cell").alias("block"), *(F.col(c[1:]).alias(c) for c in box), F.lit(False).alias("single"))
    cell = ["cell", "n", "leaf", *(f"{e}{d}" for e in ("lo", "hi") for d in range(dims))]
    pairs = stored(_reach(blocks.join(right.nodes.where("level = 0").select("g", *cell), "g").drop("g"), dims, k), "pairs")
    children = right.nodes.where("parent is not null").select("parent", *cell)
    rows, split = left.rows.withColumn("block", F.col("leaf")), []
    for _ in range(right.levels):
        inner = pairs.where("not leaf")
        if inner.isEmpty():
            break
        below = inner.withColumn("parent", F.col("cell")).drop(*cell).join(children, "parent").select(pairs.columns)
        after = stored(_reach(below.unionByName(pairs.where("leaf")), dims, k), "pairs")
        discard(pairs)
        pairs = after
        wide = stored(pairs.where("not single").groupBy("block").agg(F.count("*").alias("m")).where(F.col("m") > most).select("block"), "wide")
        if not wide.isEmpty():
            split.append(wide)
            points = [F.col(axes[d]).alias(f"b{e}{d}") for e in ("lo", "hi") for d in range(dims)]
            singles = left.rows.withColumnRenamed("leaf", "block").join(wide, "block").select("block", F.concat_ws("/", "block", F.col("key").cast("string")).alias("own"), *points)
            again = pairs.join(wide, "block").drop(*box, "single").join(singles, "block").drop("block").withColumnRenamed("own", "block").withColumn("single", F.lit(True))
            after = stored(_reach(again.select(pairs.columns), dims, k).unionByName(pairs.join(wide, "block", "left_anti").select(pairs.columns)), "pairs")
            discard(pairs)
            pairs = after
    for wide in split:
        rows = rows.join(wide.withColumnRenamed("block", "leaf").withColumn("wide", F.lit(True)), "leaf", "left").withColumn("block", F.when(F.col("wide"), F.concat_ws("/", "leaf", F.col("key").cast("string"))).otherwise(F.col("block"))).drop("wide")
    return pairs.select("block", F.col("cell").alias("leaf")), rows.drop("leaf")


def _measured(left: pa.Table, right: pa.Table, dims: int, k: int, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest right rows of each left row, by distance, then key; right rows are in order of their keys."""
    own, other = (np.stack([t[a].to_numpy() for a in _axes(dims)], 1) for t in (left, right))
    n, m = len(own), len(other)
    places, found = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    if not m:
        return places, found
    same = {key: i for i, key in enumerate(right["key"].to_pylist())} if apart else {}
    step = max(1, _DISTANCES // m)
    for at in range(0, n, step):
        part = own[at : at + step]
        d = np.zeros((len(part), m))
        for axis in range(dims):
            gap = part[:, axis, None] - other[None, :, axis]
            d += gap * gap
        if apart:
            for i, key in enumerate(left["key"].slice(at, step).to_pylist()):
                if key in same:
                    d[i, same[key]] = np.inf
        places[at : at + step], found[at : at + step] = _smallest(d, k)
    return places, found


def _smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` smallest values of each row, ties to the first column; -1 where there are fewer finite ones."""
    places, found = np.full((len(d), k), -1, np.int64), np.full((len(d), k), np.inf)
    take = min(k, d.shape[1])
    limit = np.partition(d, take - 1, axis=1)[:, take - 1]
    row, col = np.nonzero(d <= limit[:, None])
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (rank < take) & (d[row, col] < np.inf)
    places[row[keep], rank[keep]], found[row[keep], rank[keep]] = col[keep], d[row[keep], col[keep]]
    return places, found


def _halved(xyz: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in parts of at most ``most``, halved in the middle of their widest axis."""
    parts, left = [], [np.arange(len(xyz))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            parts.append(rows)
            continue
        own = xyz[rows]
        order = np.argpartition(own[:, np.ptp(own, 0).argmax()], len(rows) // 2)
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return parts


def nearest_others(xyz: np.ndarray, asking: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest other rows of each asking row, ties to the first row; -1 where there are fewer, and for rows that don't ask.

    Parts of a few dozen rows look at the parts that begin no farther away than the k-th row of their own.
    """
    places = np.full((len(xyz), k), -1, np.int64)
    parts = _halved(xyz, max(_PART_ROWS, 4 * k + 4))
    axes, (low, high) = np.ascontiguousarray(xyz.T), (np.stack([end(xyz[p], 0) for p in parts], 1) for end in (np.min, np.max))

    def away(low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Squares of the least distances between boxes, an array an axis, and one box, a little less to be safe."""
        gaps = (np.maximum(np.maximum(a - d, c - b), 0) for a, b, c, d in zip(low, high, first, last, strict=True))
        return sum(gap * gap for gap in gaps) * (1 - 1e-12)

    def squares(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        d = np.zeros((len(own), len(other)))
        for axis in range(xyz.shape[1]):
            gap = own[:, axis, None] - other[None, :, axis]
            d += gap * gap
        return d

    for i, part in enumerate(parts):
        mine = part[asking[part]]
        if not len(mine):
            continue
        own = xyz[mine]
        bound = np.partition(squares(own, xyz[part]), k, axis=1)[:, k] if len(part) > k else np.full(len(mine), np.inf)
        reach, first, last = bound.max(), own.min(0), own.max(0)
        near = np.concatenate([parts[j] for j in np.flatnonzero(away(low, high, first, last) <= reach)])
        at = axes[:, near]
        near = np.sort(near[away(at, at, first, last) <= reach])
        step = max(1, _DISTANCES // len(near))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            d = squares(own[at : at + step], xyz[near])
            d[np.arange(len(some)), np.searchsorted(near, some)] = np.inf
            found, _ = _smallest(d, k)
            places[some] = np.where(found >= 0, near[found], -1)
    return places


def each_nearest(left: DataFrame, right: DataFrame, k: int, finish: Finish, schema: str, coordinates: Sequence[str], by: str | None, key: str, right_key: str, apart: bool, more: Sequence[str] = (), leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Applies ``finish`` to each block of left rows and its answer; ``apart`` leaves out the right row with a row's own key. Both sides keep the columns ``more``."""
    dims = len(coordinates)
    ours = _prepared(left, coordinates, by, key, more)
    theirs = ours if left is right and key == right_key else _prepared(right, coordinates, by, right_key, more)
    pyramids = _pyramids(ours, theirs, dims, leaf_rows)
    if pyramids is None:
        return left.sparkSession.createDataFrame([], schema)
    a, b = pyramids
    wanted, mine = _wanted(a, b, dims, k + apart)
    asked = b.rows.withColumnRenamed("leaf", "from").join(wanted.withColumnRenamed("leaf", "from"), "from").select("block", "key", *_axes(dims), *more)

    empty = _arrow_schema(schema).empty_table()

    def answered(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not len(mine):
            return empty
        others = others.sort_by("key")
        return finish(mine, others, *_measured(mine, others, dims, k, apart))

    return mine.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(answered, schema)


def count_within(left: DataFrame, right: DataFrame, radius: float, key: str = "point_id", coordinates: Sequence[str] = ("x", "y"), leaf_rows: int = 4 * LEAF_ROWS) -> DataFrame:
    """Number of right rows at most ``radius`` from each left row: (key, n).

    Blocks go down the right side's pyramid: a cell that lies within the radius of the whole block adds its count, one that is out of reach is dropped, and only leaves on
    the rim of the circle are measured row by row, inside the block's task. Rows with a missing coordinate are left out on both sides.
    """
    dims, kind = len(coordinates), left.schema[key].dataType.simpleString()
    ours, theirs = _prepared(left, coordinates, None, key, ()), _prepared(right, coordinates, None, right.columns[0], ())
    pyramids = _pyramids(ours, theirs, dims, leaf_rows)
    if pyramids is None:
        return left.sparkSession.createDataFrame([], f"{key} {kind}, n long")
    a, b = pyramids
    sides = ["lo", "hi"]
    boxes = [F.col(f"{e}{d}").alias(f"b{e}{d}") for e in sides for d in range(dims)]
    cell = ["cell", "n", "leaf", *(f"{e}{d}" for e in sides for d in range(dims))]
    blocks = a.nodes.where("leaf").select("g", F.col("cell").alias("block"), *boxes)
    near, far = _gaps(dims)
    limit = radius * radius
    children, whole, rim = b.nodes.where("parent is not null").select("parent", *cell), [], []
    pairs = blocks.join(b.nodes.where("level = 0").select("g", *cell), "g").drop("g")
    for _ in range(b.levels + 1):
        pairs = stored(pairs.withColumns({"near": near, "far": far}).where(F.col("near") * (1 - 1e-12) <= limit).withColumn("whole", F.col("far") * (1 + 1e-12) <= limit).drop("near", "far"), "pairs")
        whole.append(pairs.where("whole").select("block", "n"))
        rim.append(pairs.where("leaf and not whole").select("block", F.col("cell").alias("from")))
        inner = pairs.where("not leaf and not whole")
        if inner.isEmpty():
            break
        pairs = inner.withColumn("parent", F.col("cell")).drop("whole", *cell).join(children, "parent").drop("parent")
    sure = reduce(DataFrame.unionByName, whole).groupBy("block").agg(F.sum("n").alias("sure"))
    mine = a.rows.withColumnRenamed("leaf", "block")
    known = sure.select("block", "sure", *(F.lit(None).cast("double").alias(c) for c in _axes(dims)))
    asked = b.rows.withColumnRenamed("leaf", "from").join(reduce(DataFrame.unionByName, rim), "from").select("block", F.lit(None).cast("long").alias("sure"), *_axes(dims))
    schema = f"{key} {kind}, n long"
    empty = _arrow_schema(schema).empty_table()

    def counted(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not len(mine):
            return empty
        base, others = sum(others["sure"].drop_null().to_pylist()), others.filter(pc.is_null(others["sure"]))
        own, other = (np.stack([t[c].to_numpy() for c in _axes(dims)], 1) for t in (mine, others))
        out = np.full(len(own), base, np.int64)
        step = max(1, _DISTANCES // max(1, len(other)))
        for at in range(0, len(own), step):
            d = np.zeros((len(own[at : at + step]), len(other)))
            for axis in range(dims):
                gap = own[at : at + step, axis, None] - other[None, :, axis]
                d += gap * gap
            out[at : at + step] += (d <= limit).sum(1)
        return pa.table({key: mine["key"], "n": out})

    return mine.groupBy("block").cogroup(known.unionByName(asked).groupBy("block")).applyInArrow(counted, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def k_nearest(left: DataFrame, right: DataFrame, k: int, coordinates: Sequence[str] = ("x", "y"), by: str | None = None, key: str = "point_id", right_key: str = "ground_id", apart: bool = False, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The ``k`` nearest right rows of each left row, of the same group where ``by`` is given: (by, key, keys, distances), nearest first, ties to the smaller key.

    Rows that no right row can answer have empty arrays; rows with a missing coordinate or group give no row. With ``apart`` the right row of a row's own key doesn't count. Keys are
    one row each.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, key), (right, right_key))}
    group = f"{by} {left.schema[by].dataType.simpleString()}, " if by else ""

    def finish(mine: pa.Table, others: pa.Table, places: np.ndarray, found: np.ndarray) -> pa.Table:
        there = places >= 0
        offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        keys = pa.ListArray.from_arrays(offsets, others["key"].combine_chunks().take(pa.array(places[there])))
        columns = {key: mine["key"], "keys": keys, "distances": pa.ListArray.from_arrays(offsets, pa.array(np.sqrt(found[there])))}
        return pa.table({by: mine["g"], **columns} if by else columns)

    schema = f"{group}{key} {kinds[key]}, keys array<{kinds[right_key]}>, distances array<double>"
    return each_nearest(left, right, k, finish, schema, coordinates, by, key, right_key, apart, leaf_rows=leaf_rows)


def linearity(points: DataFrame, by: str, key: str = "point_id", k: int = 20, leaf_rows: int = LEAF_ROWS, copies: str | None = None, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """(l1 - l2) / l1 of the covariance of each point's ``k`` nearest others of its tree: (by, key, linearity).

    A tree of at most ``whole_rows`` rows is one task's arrays; larger ones go by pyramids of cells, block by block.
    Points of trees with ``k`` points or fewer score 0.5; points of no tree, with an id of 0 or less, score 0. With ``copies`` a row stands for so many points of one place, of which all
    have its score, and no two rows of a tree have one place: more than ``k`` copies are each other's nearest, a single place without any spread, and score 0 at once.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in (by, key)}
    schema = f"{by} {kinds[by]}, {key} {kinds[key]}, linearity double"
    place = lambda t: np.stack([t[a].to_numpy() for a in _axes(3)], 1)
    number = lambda t: t[copies].to_numpy() if copies else np.ones(len(t), np.int64)

    def scores(own: np.ndarray, others: np.ndarray, number_own: np.ndarray, number_others: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.full(len(own), 0.5)
        upto = np.cumsum(np.column_stack([number_own - 1, np.append(number_others, 0)[places]]), axis=1)  # its own copies, then those of the places by distance
        full = upto[:, -1] >= k
        if full.any():
            at = np.column_stack([len(others) + np.arange(len(own)), places])[full]
            slots = (upto[full][:, None, :] <= np.arange(k)[None, :, None]).sum(2) if copies else np.arange(1, k + 1)[None]
            out[full] = line_share(np.concatenate([others, own])[np.take_along_axis(at, slots, 1)])
        return out

    def finish(mine: pa.Table, others: pa.Table, places: np.ndarray, found: np.ndarray) -> pa.Table:
        return pa.table({by: mine["g"], key: mine["key"], "linearity": scores(place(mine), place(others), number(mine), number(others), places)})

    def whole(tree: pa.Table) -> pa.Table:
        tree = tree.sort_by("key")
        xyz, n = place(tree), number(tree)
        asking = n <= k if copies else np.ones(len(n), bool)
        out = np.zeros(len(n))
        for at in range(0, len(n), 1 << 15) if asking.any() else ():
            if not at:
                places = nearest_others(xyz, asking, k)
            some = np.flatnonzero(asking[at : at + (1 << 15)]) + at
            out[some] = scores(xyz[some], xyz, n[some], n, places[some])
        return pa.table({by: tree["g"], key: tree["key"], "linearity": out})

    more, few, trees = [copies] if copies else [], F.col(copies) <= k if copies else F.lit(True), points.where(F.col(by) > 0)
    zero = lambda rows: rows.select(by, key, F.lit(0.0).alias("linearity"))
    asks, small = F.col("_few") > 0, F.col("_rows") <= whole_rows
    sizes = stored(trees.groupBy(by).agg(F.count("*").alias("_rows"), F.count_if(few).alias("_few")), "sizes")
    found = zero(points.where(F.col(by) <= 0))
    ways = (~asks, asks & small, asks & ~small)
    number_of = sizes.agg(*map(F.count_if, ways)).first()
    for way, wanted in enumerate(ways):
        if not number_of[way]:
            continue
        some = trees if number_of[way] == sum(number_of) else trees.join(sizes.where(wanted).select(by), by, "left_semi")
        if way == 0:
            done = zero(placed_rows(some, ("x", "y", "z")))
        elif way == 1:  # fits cost far more than their rows weigh, so trees are dealt to all shuffle partitions
            dealt = _prepared(some, ("x", "y", "z"), by, key, more).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g")
            done = dealt.groupBy("g").applyInArrow(whole, schema)
        else:
            lone = some.where(~few) if copies else None
            apart = copies is not None and not lone.isEmpty()
            done = each_nearest(some.where(few) if apart else some, some, k, finish, schema, ("x", "y", "z"), by, key, key, True, more, leaf_rows)
            done = done.unionByName(zero(placed_rows(lone, ("x", "y", "z")))) if apart else done
        found = found.unionByName(done)
    return found


def line_share(groups: np.ndarray) -> np.ndarray:
    """(l1 - l2) / l1 of the covariances of sets of points, an array of sets x points x 3."""
    centred = groups - groups.mean(1, keepdims=True)
    values = np.linalg.eigvalsh(np.einsum("nki,nkj->nij", centred, centred) / max(groups.shape[1] - 1, 1))
    return (values[:, 2] - values[:, 1]) / (values[:, 2] + 1e-9)

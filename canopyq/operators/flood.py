"""Priority flood of a raster in tiles: every cell is raised until it drains to the rim over cells that rise by at least a step.

A raised height is the least over paths from the rim of a fold of two rules: at least the cell's own height, and at least the step above the cell before. A path through a tile acts
on the height it begins with as ``max(a, height + k * step)``, and such functions compose, so a tile is a small graph between the cells on its border. Graphs of
tiles are merged in squares of tiles, level by level, each in one task; inner cells drop out, as in a flood with labels only edges between neighbouring labels stay.
On the way down every border cell gets the height of a path to the rim, and each tile is flooded from its border. Last, tiles are flooded again from their neighbours' cells
until none changes: without a step none does, with one a path of fewer steps may be better than the lowest. The answer is that of one flood over the whole raster.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.plans.storage import discard, stored

Node = tuple[int, int]
_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_LOWEST = -math.inf
_EDGES = "site {kind}, from_row long, from_col long, to_row long, to_col long, a double, k long"


class TileGrid:
    """Cells of a tile and of the ring around it, one list entry each; ``open`` marks the tile's own cells, ``ring`` those around it."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, corner: Node, size: int, step: float) -> None:
        self.corner, self.width, self.step = corner, size + 4, step  # one more cell on each side, so neighbours never leave the list
        n = self.width * self.width
        self.v, self.open, self.there = [math.nan] * n, bytearray(n), bytearray(n)
        at = ((rows - corner[0] + 2) * self.width + cols - corner[1] + 2).tolist()
        own = (rows >= corner[0]) & (rows < corner[0] + size) & (cols >= corner[1]) & (cols < corner[1] + size)
        for i, value, mine in zip(at, values.tolist(), own.tolist(), strict=True):
            self.v[i], self.there[i], self.open[i] = value, 1, mine
        self.at, self.own = at, own
        self.offsets = [a * self.width + b for a, b in _AROUND]
        self.cells = [i for i, mine in zip(at, own.tolist(), strict=True) if mine]
        self.rim = [i for i in self.cells if not all(self.there[i + o] for o in self.offsets)]
        self.border = [i for i in self.cells if any(self.there[i + o] and not self.open[i + o] for o in self.offsets)]

    def node(self, i: int) -> Node:
        return i // self.width - 2 + self.corner[0], i % self.width - 2 + self.corner[1]

    def flooded(self, seeds: Iterable[tuple[int, float]]) -> list[float]:
        """Heights of all cells, from seeds and the rim."""
        out, heap = [math.inf] * len(self.v), []
        for i, z in [*seeds, *((i, self.v[i]) for i in self.rim)]:
            if z < out[i]:
                out[i] = z
                heap.append((z, i))
        heapq.heapify(heap)
        while heap:
            z, i = heapq.heappop(heap)
            if z > out[i]:
                continue
            z += self.step
            for o in self.offsets:
                j = i + o
                if self.open[j]:
                    nz = z if z > self.v[j] else self.v[j]
                    if nz < out[j]:
                        out[j] = nz
                        heapq.heappush(heap, (nz, j))
        return out

    def graph(self) -> dict[tuple[Node | None, Node], tuple[float, int]]:
        """Edges between the tile's border cells, and from the rim (None), by a flood in which each border cell is a label."""
        graph = Graph(self.step)
        rim = set(self.rim)
        for i in self.rim:
            graph.source(i, self.v[i])
        for i in self.border:
            if i not in rim:
                graph.label(i, self.v[i])
        steps = lambda i: ((i + o, self.v[i + o], 1) for o in self.offsets if self.open[i + o] and i + o not in rim)
        back = lambda i, j: (self.v[i], 1)
        found = graph.reduced(steps, back)
        named = {(None if p is None else self.node(p), self.node(q)): edge for (p, q), edge in found.items()}
        for i in self.border:  # border cells on the rim keep their own height
            if i in rim:
                named[None, self.node(i)] = (self.v[i], 0)
        return named


class Graph:
    """A flood with labels over nodes and edges that act as ``max(a, height + k * step)``."""

    def __init__(self, step: float) -> None:
        self.step, self.z, self.owner, self.forward, self.backward, self.heap = step, {}, {}, {}, {}, []

    def source(self, node, height: float) -> None:
        """A node that the rim reaches at a height."""
        if height < self.z.get(node, math.inf):
            self.z[node], self.owner[node], self.forward[node], self.backward[node] = height, None, (height, 0), (_LOWEST, 0)
            heapq.heappush(self.heap, (height, node))

    def label(self, node, height: float) -> None:
        """A node that keeps its own label; its height is a lower limit."""
        if node not in self.z:
            self.z[node], self.owner[node], self.forward[node], self.backward[node] = height, node, (_LOWEST, 0), (_LOWEST, 0)
            heapq.heappush(self.heap, (height, node))

    def reduced(self, steps, back) -> dict:
        """Edges (from label or None for the rim, to label) -> (a, k). ``steps`` gives (node, a, k) of a node's edges, ``back`` the (a, k) of an edge's way back."""
        done, labels = set(), {n for n, owner in self.owner.items() if owner is not None}
        while self.heap:
            z, i = heapq.heappop(self.heap)
            if i in done or z > self.z[i]:
                continue
            done.add(i)
            fa, fk = self.forward[i]
            ba, bk = self.backward[i]
            for j, a, k in steps(i):
                if j in done or j in labels:
                    continue
                nz = max(a, z + k * self.step)
                if nz < self.z.get(j, math.inf):
                    ra, rk = back(i, j)
                    self.z[j], self.owner[j] = nz, self.owner[i]
                    self.forward[j] = max(a, fa + k * self.step), fk + k
                    self.backward[j] = max(ba, ra + bk * self.step), bk + rk
                    heapq.heappush(self.heap, (nz, j))
        found: dict = {}
        for i in done:
            p, (fa, fk) = self.owner[i], self.forward[i]
            for j, a, k in steps(i):
                q = self.owner.get(j)
                if q is None or q == p or j not in done:
                    continue
                ba, bk = self.backward[j]
                edge = max(ba, max(a, fa + k * self.step) + bk * self.step), fk + k + bk
                best = found.get((p, q))
                if best is None or edge < best:
                    found[p, q] = edge
        return {pq: (a, 0 if pq[0] is None else k) for pq, (a, k) in found.items()}


class Square:
    """The graph of a square of tiles: edges inside, from the rim, and from cells outside to its own border cells."""

    def __init__(self, edges: pd.DataFrame, inside, step: float) -> None:
        self.step, self.out, self.sources, self.crossing = step, {}, {}, {}
        self.back: dict[tuple[Node, Node], tuple[float, int]] = {}
        self.crossing_edges: dict[tuple[Node, Node], tuple[float, int]] = {}
        for fr, fc, tr, tc, a, k in zip(*(edges[c].tolist() for c in ("from_row", "from_col", "to_row", "to_col", "a", "k")), strict=True):
            to = (tr, tc)
            if fr is None or fr != fr:
                self.sources[to] = min(a, self.sources.get(to, math.inf))
            elif inside(int(fr), int(fc)):
                self.out.setdefault((int(fr), int(fc)), []).append((to, a, k))
                self.back[(int(fr), int(fc)), to] = (a, k)
            else:
                self.crossing[to] = a  # a step onto a cell: its own height
                self.crossing_edges[(int(fr), int(fc)), to] = (a, k)

    def reduced(self) -> dict:
        """Edges between the square's own border cells and from the rim."""
        graph = Graph(self.step)
        for node, z in self.sources.items():
            if node not in self.crossing:
                graph.source(node, z)
        for node, z in self.crossing.items():
            graph.label(node, z)
        found = graph.reduced(lambda i: self.out.get(i, ()), lambda i, j: self.back.get((j, i), (_LOWEST, 0)))  # none lead onto the rim, and the rim's own need none
        for node, z in self.sources.items():  # the rim reaches a node that a label flooded: it reaches the label's cell by the way back
            label = graph.owner[node]
            if label is not None:
                a, k = graph.backward[node]
                found[None, label] = min((max(a, z + k * self.step), 0), found.get((None, label), (math.inf, 0)))
        return found

    def heights(self, known: dict[Node, float]) -> dict[Node, float]:
        """Heights of all nodes, from the rim and from border cells whose heights are known."""
        z, heap = {}, []
        for node, height in [*self.sources.items(), *known.items()]:
            if height < z.get(node, math.inf):
                z[node] = height
                heap.append((height, node))
        heapq.heapify(heap)
        while heap:
            height, i = heapq.heappop(heap)
            if height > z[i]:
                continue
            for j, a, k in self.out.get(i, ()):
                nz = max(a, height + k * self.step)
                if nz < z.get(j, math.inf):
                    z[j] = nz
                    heapq.heappush(heap, (nz, j))
        return z


def _with_ring(cells: DataFrame, tile: int, *extra: str) -> DataFrame:
    """Cells by the tile that owns them and by tiles whose ring they stand on."""
    spans = [F.array_distinct(F.array(*(F.floor((F.col(c) + d) / tile) for d in (-1, 0, 1)))) for c in ("row", "col")]
    return cells.withColumn("ti", F.explode(spans[0])).withColumn("tj", F.explode(spans[1])).select("site", "row", "col", "value", *extra, "ti", "tj")


def priority_flood(grid: DataFrame, by: str, step: float = 1e-3, tile: int = 256, merge: int = 4) -> DataFrame:
    """Depression-free surface of each site's raster: (by, row, col, value). The rim is every cell with a neighbour missing, so sites of any shape, with holes, drain everywhere.

    A task holds one tile of ``tile`` x ``tile`` cells, or the border cells of ``merge`` x ``merge`` smaller squares. Cells without a value or site count as missing.
    """
    source = grid.where(F.col(by).isNotNull() & F.col("value").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull())
    cells = stored(source.select(F.col(by).alias("site"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), "flood-cells")
    ends = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    kind = grid.schema[by].dataType.simpleString()
    named = [F.col("site").alias(by), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value"]
    if ends[0] is None:
        return cells.select(*named)
    first, span = (ends[0], ends[2]), max(ends[1] - ends[0], ends[3] - ends[2]) + 1
    schema, moved = _EDGES.format(kind=kind), cells.withColumns({"row": F.col("row") - first[0], "col": F.col("col") - first[1]})
    rung = _with_ring(moved, tile)

    def opened(key: tuple, pdf: pd.DataFrame) -> TileGrid:
        return TileGrid(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["value"].to_numpy(), (key[1] * tile, key[2] * tile), tile, step)

    def edge_table(site, found: dict) -> pd.DataFrame:
        rows = [(site, *(p or (None, None)), *q, a, k) for (p, q), (a, k) in found.items()]
        out = pd.DataFrame(rows, columns=["site", "from_row", "from_col", "to_row", "to_col", "a", "k"])
        return out.astype({"from_row": "Int64", "from_col": "Int64"})

    def tile_graph(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = opened(key, pdf)
        found, rim = t.graph(), set(t.rim)
        for i in t.border:  # steps onto it from other tiles
            if i not in rim:
                for o in t.offsets:
                    if t.there[i + o] and not t.open[i + o]:
                        found[t.node(i + o), t.node(i)] = (t.v[i], 1)
        return edge_table(key[0], found)

    def at(level: int, row: str, col: str) -> list[Column]:
        side = tile * merge**level
        return [F.floor(F.col(row) / side).alias("ti"), F.floor(F.col(col) / side).alias("tj")]

    def square_of(level: int, key: tuple, pdf: pd.DataFrame) -> Square:
        side = tile * merge**level
        return Square(pdf, lambda r, c: r // side == key[1] and c // side == key[2], step)

    def merged(level: int):
        def merge_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            square = square_of(level, key, pdf)
            return edge_table(key[0], square.reduced() | square.crossing_edges)

        return merge_one

    def lowered(level: int):
        def lower_one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            given = {(r, c): z for r, c, z in zip(right["row"].tolist(), right["col"].tolist(), right["z"].tolist(), strict=True)}
            found = square_of(level, key, left).heights(given)
            return pd.DataFrame([(key[0], r, c, z) for (r, c), z in found.items()], columns=["site", "row", "col", "z"])

        return lower_one

    levels = [stored(rung.groupBy("site", "ti", "tj").applyInPandas(tile_graph, schema), "flood-edges")]
    while tile * merge ** len(levels) < span:
        before = levels[-1].select("*", *at(len(levels), "to_row", "to_col"))
        levels.append(stored(before.groupBy("site", "ti", "tj").applyInPandas(merged(len(levels)), schema), "flood-edges"))

    known = cells.select("site", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(0.0).alias("z")).limit(0)
    for level in range(len(levels), 0, -1):
        left = levels[level - 1].select("*", *at(level, "to_row", "to_col")).groupBy("site", "ti", "tj")
        right = known.select("*", *at(level, "row", "col")).groupBy("site", "ti", "tj")
        known = stored(left.cogroup(right).applyInPandas(lowered(level), f"site {kind}, row long, col long, z double"), "flood-heights")
    discard(*levels)

    def filled(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t = opened(key, left)
        place = {t.node(i): i for i in t.border}
        seeds = [(place[r, c], z) for r, c, z in zip(right["row"].tolist(), right["col"].tolist(), right["z"].tolist(), strict=True) if (r, c) in place]
        return left[t.own].assign(z=[z for z, mine in zip(map(t.flooded(seeds).__getitem__, t.at), t.own.tolist(), strict=True) if mine])[["site", "row", "col", "value", "z"]]

    out_schema = f"site {kind}, row long, col long, value double, z double"
    seeds = known.select("*", *at(0, "row", "col")).groupBy("site", "ti", "tj")
    surface = stored(rung.groupBy("site", "ti", "tj").cogroup(seeds).applyInPandas(filled, out_schema), "flood-filled")

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = opened(key, pdf)
        before = pdf["z"].tolist()
        out = t.flooded((i, z) for i, z, mine in zip(t.at, before, t.own.tolist(), strict=True) if not mine)
        after = [out[i] for i in t.at]
        better = [mine and a < b - 1e-9 * max(1.0, abs(b)) for a, b, mine in zip(after, before, t.own.tolist(), strict=True)]
        found = pdf.assign(z=after, better=better)[t.own]
        return found[["site", "row", "col", "value", "z", "better"]] if any(better) else found.iloc[:0][["site", "row", "col", "value", "z", "better"]]

    active: DataFrame | None = None
    while True:
        dealt = _with_ring(surface, tile, "z")
        if active is not None:
            dealt = dealt.join(active, ["site", "ti", "tj"], "left_semi")
        better = stored(dealt.groupBy("site", "ti", "tj").applyInPandas(again, out_schema + ", better boolean"), "flood-better")
        if better.isEmpty():
            discard(better)
            return surface.select(F.col("site").alias(by), (F.col("row") + first[0]).cast("int").alias("row"), (F.col("col") + first[1]).cast("int").alias("col"), F.col("z").alias("value"))
        changed = better.select("site", *at(0, "row", "col")).distinct()
        active = stored(_with_ring(better.where("better"), tile).select("site", "ti", "tj").distinct(), "flood-active")
        rest = surface.select("*", *at(0, "row", "col")).join(changed, ["site", "ti", "tj"], "left_anti").drop("ti", "tj")
        surface = stored(rest.unionByName(better.drop("better")), "flood-filled")

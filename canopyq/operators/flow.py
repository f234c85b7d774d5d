"""Flow accumulation in tiles: sums along pointers within each tile, and over the few cells where flow enters one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.operators.grid import d8
from canopyq.plans.storage import discard, stored


class Pointers:
    """The cells of a tile and where each drains: another of them, or -1 for a pit or a cell outside."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, to_rows: np.ndarray, to_cols: np.ndarray) -> None:
        n = len(rows)
        self.place = {cell: i for i, cell in enumerate(zip(rows.tolist(), cols.tolist(), strict=True))}
        self.to = list(zip(to_rows.tolist(), to_cols.tolist(), strict=True))
        self.next = [self.place.get(cell, -1) for cell in self.to]
        waits = [0] * n
        for j in self.next:
            if j >= 0:
                waits[j] += 1
        order = [i for i in range(n) if not waits[i]]
        for i in order:  # grows as cells become free: each comes after all that drain into it
            j = self.next[i]
            if j >= 0:
                waits[j] -= 1
                if not waits[j]:
                    order.append(j)
        if len(order) < n:
            raise RuntimeError("the directions hold a cycle")
        self.order = order

    def sums(self, amounts: list[float]) -> list[float]:
        """Each cell's amount and all that drain through it."""
        out = list(amounts)
        for i in self.order:
            if self.next[i] >= 0:
                out[self.next[i]] += out[i]
        return out

    def ends(self) -> list[int]:
        """The last cell of each cell's way within the tile."""
        out = list(range(len(self.next)))
        for i in reversed(self.order):
            if self.next[i] >= 0:
                out[i] = out[self.next[i]]
        return out


def forest_sums(nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Totals over the trees that pointers make: (row, col, total) of nodes (row, col, to_row, to_col, amount).

    Jumps double each round: a node sends its sum to where its pointer leads, and pointers skip ahead, so rounds are logarithmic in the longest way, and the limit
    stands for a way of 2^60 nodes. Nodes whose pointer has come to an end send nothing more. Many nodes may point at one: sums are combined before they move, and the
    join that moves pointers splits such a node's side.
    """
    at = lambda r, c: F.struct(F.col(r).alias("row"), F.col(c).alias("col"))
    state = stored(nodes.select(at("row", "col").alias("node"), F.when(F.col("to_row").isNotNull(), at("to_row", "to_col")).alias("jump"), F.col("amount").cast("long").alias("total")), "forest")
    for _ in range(max_rounds):
        moving = state.where("jump is not null")
        if moving.isEmpty():
            return state.select("node.row", "node.col", "total")
        gain = moving.groupBy(F.col("jump").alias("node")).agg(F.sum("total").alias("gain"))
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("then"))
        moved = moving.join(ahead, "jump", "left").select("node", F.col("then").alias("jump"), "total").unionByName(state.where("jump is null"))
        after = stored(moved.join(gain, "node", "left").select("node", "jump", (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total")), "forest")
        discard(state)
        state = after
    raise RuntimeError("flow did not settle; the directions hold a cycle")


def flow_accumulation(grid: DataFrame, size: float = 1.0, tile: int = 256) -> DataFrame:
    """Cells that drain through each cell, itself included, along steepest descent: (row, col, cells).

    Tiles sum their own cells and tell where flow that enters them leaves; entries of all tiles form a forest, whose totals come back to the tiles. A task holds one tile.
    """
    cell = {c: F.floor(F.col(c) / tile) for c in ("row", "col")}
    flow = stored(d8(grid, size).select("row", "col", "to_row", "to_col", cell["row"].alias("ti"), cell["col"].alias("tj")), "flow")
    crossing = flow.where((F.floor(F.col("to_row") / tile) != F.col("ti")) | (F.floor(F.col("to_col") / tile) != F.col("tj")))
    entries = crossing.select(F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct().select("*", cell["row"].alias("ti"), cell["col"].alias("tj"))

    def pointers(pdf: pd.DataFrame) -> Pointers:
        return Pointers(*(pdf[c].fillna(np.iinfo(np.int32).min).to_numpy(np.int64) for c in ("row", "col", "to_row", "to_col")))

    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of each entry where its flow enters next, and of each cell that leaves the tile how much of the tile's own it carries there."""
        if left.empty:
            return pd.DataFrame(columns=["row", "col", "to_row", "to_col", "amount"])
        p = pointers(left)
        known = left["to_row"].notna().tolist()
        own, ends = p.sums([1] * len(left)), p.ends()
        out = []
        for r, c in zip(right["row"].tolist(), right["col"].tolist(), strict=True):
            end = ends[p.place[r, c]]
            out.append((r, c, *(p.to[end] if known[end] else (None, None)), 0))
        out += [(*p.to[i], None, None, own[i]) for i, j in enumerate(p.next) if j < 0 and known[i]]
        return pd.DataFrame(out, columns=["row", "col", "to_row", "to_col", "amount"]).astype({"to_row": "Int64", "to_col": "Int64"})

    tiles = flow.groupBy("ti", "tj")
    found = stored(tiles.cogroup(entries.groupBy("ti", "tj")).applyInPandas(links, "row int, col int, to_row int, to_col int, amount long"), "flow-links")
    nodes = found.groupBy("row", "col").agg(F.max("to_row").alias("to_row"), F.max("to_col").alias("to_col"), F.sum("amount").alias("amount"))  # one row of an entry at most has a target
    inflow = forest_sums(nodes).select("*", cell["row"].alias("ti"), cell["col"].alias("tj"))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, amounts = pointers(left), [1] * len(left)
        for r, c, total in zip(right["row"].tolist(), right["col"].tolist(), right["total"].tolist(), strict=True):
            amounts[p.place[r, c]] += total
        return left[["row", "col"]].assign(cells=p.sums(amounts))

    return tiles.cogroup(inflow.groupBy("ti", "tj")).applyInPandas(sums, "row int, col int, cells long")

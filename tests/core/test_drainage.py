"""Tiled priority flood and flow accumulation against plain versions over the whole grid."""

import heapq

import numpy as np
import pandas as pd
import pytest

from canopyq.operators import flood, flow, grid

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def plain_flood(cells, step):
    rim = [(z, c) for c, z in cells.items() if any((c[0] + a, c[1] + b) not in cells for a, b in AROUND)]
    out, heap = {c: z for z, c in rim}, list(rim)
    heapq.heapify(heap)
    while heap:
        z, (r, c) = heapq.heappop(heap)
        for a, b in AROUND:
            n = r + a, c + b
            if n in cells and n not in out:
                out[n] = max(cells[n], z + step)
                heapq.heappush(heap, (out[n], n))
    return out


def surfaces():
    rng = np.random.default_rng(0)
    noise = rng.uniform(0, 10, (40, 40))
    lakes = np.round(5 + rng.uniform(0, 0.02, (60, 60)), 3)
    lakes[10:50, 5:55] = 1
    lakes[9:51, 4] = 20
    smooth = np.add.outer(np.sin(np.arange(50) / 7), np.cos(np.arange(50) / 5)) * 3
    return {"noise": (noise, 1.0), "holes": (rng.uniform(0, 10, (45, 45)), 0.97), "lakes": (lakes, 1.0), "valleys": (smooth, 1.0), "thin": (rng.uniform(0, 5, (3, 70)), 1.0)}


@pytest.mark.parametrize("name,tile,merge,step", [("noise", 8, 2, 1e-3), ("noise", 8, 2, 0.0), ("holes", 7, 3, 0.05), ("lakes", 8, 2, 1e-2), ("valleys", 16, 4, 1e-3), ("thin", 4, 2, 0.1), ("noise", 64, 4, 1e-3)])
def test_tiled_flood_is_the_whole_flood(spark, name, tile, merge, step):
    values, share = surfaces()[name]
    keep = np.random.default_rng(1).uniform(size=values.shape) <= share
    cells = {(int(r) - 3, int(c) + 5): float(values[r, c]) for r, c in zip(*np.nonzero(keep), strict=True)}
    table = pd.DataFrame([(1, *k, v) for k, v in cells.items()] + [(2, *k, -v) for k, v in list(cells.items())[:50]], columns=["site", "row", "col", "value"])
    got = flood.priority_flood(spark.createDataFrame(table), "site", step, tile, merge).toPandas()
    for site, part in ((1, cells), (2, {k: -v for k, v in list(cells.items())[:50]})):
        want = plain_flood(part, step)
        mine = {(r, c): v for s, r, c, v in got.itertuples(index=False) if s == site}
        assert mine.keys() == want.keys() and max(abs(mine[k] - want[k]) for k in want) < 1e-9


def test_flood_of_nothing_and_of_missing_values(spark):
    schema = "site int, row int, col int, value double"
    assert flood.priority_flood(spark.createDataFrame([], schema), "site").count() == 0
    rows = [(1, 0, 0, 3.0), (1, 0, 1, None), (None, 5, 5, 1.0), (1, None, 2, 1.0)]
    assert [tuple(r) for r in flood.priority_flood(spark.createDataFrame(rows, schema), "site").collect()] == [(1, 0, 0, 3.0)]


@pytest.mark.parametrize("tile", [5, 16, 100])
def test_flow_sums_over_tiles(spark, tile):
    values = np.random.default_rng(3).uniform(0, 10, (33, 41))
    cells = plain_flood({(r, c): float(values[r, c]) for r in range(33) for c in range(41)}, 1e-3)
    table = spark.createDataFrame(pd.DataFrame([(r, c, v) for (r, c), v in cells.items()], columns=["row", "col", "value"]).astype({"row": "int32", "col": "int32"}))
    to = {(r.row, r.col): (r.to_row, r.to_col) for r in grid.d8(table).collect()}
    want = dict.fromkeys(cells, 1)
    for k in sorted(cells, key=cells.get, reverse=True):
        if to[k][0] is not None:
            want[to[k]] += want[k]
    got = {(r.row, r.col): r.cells for r in flow.flow_accumulation(table, tile=tile).collect()}
    assert got == want and max(want.values()) > 20


def test_forest_of_a_long_chain_and_a_star(spark):
    rows = [(0, i, 0 if i else None, i - 1 if i else None, 1) for i in range(300)] + [(1, i, 1 if i else None, 0 if i else None, 2) for i in range(500)]
    got = {(r.row, r.col): r.total for r in flow.forest_sums(spark.createDataFrame(rows, "row int, col int, to_row int, to_col int, amount long")).collect()}
    assert all(got[0, i] == 300 - i for i in range(300)) and got[1, 0] == 1000 and got[1, 7] == 2

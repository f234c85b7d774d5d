"""Algorithms against brute force and their defining properties."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopyq.operators import circles, feed, graph, grid, neighbours, segments, spatial, stats, terrain
from canopyq.plans import stages
from canopyq.sources import files as sources


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    n = 400
    return pd.DataFrame({"point_id": range(n), "x": rng.uniform(-10, 20, n), "y": rng.uniform(-5, 25, n), "z": rng.uniform(0, 10, n)})


def test_suppression_equals_greedy(spark):
    rng = np.random.default_rng(1)
    tops = pd.DataFrame({"tree_id": range(200), "x": rng.uniform(0, 15, 200), "y": rng.uniform(0, 15, 200), "height_m": rng.integers(5, 12, 200).astype(float)})
    kept = []
    for r in tops.sort_values(["height_m", "tree_id"], ascending=[False, True]).itertuples():
        if all((r.x - k.x) ** 2 + (r.y - k.y) ** 2 >= 2.25 for k in kept):
            kept.append(r)
    got = {r.tree_id for r in segments.suppressed(spark.createDataFrame(tops), 1.5).collect()}
    assert got == {k.tree_id for k in kept}


def test_components_ignore_order_and_loops(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (9, 8), (3, 1), (None, 2)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}


def test_components_of_few_edges_take_one_round(spark, monkeypatch):
    names, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or kept(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    assert names == ["edges", "joins", "met", "components"]


@pytest.mark.parametrize("kind", ["long", "int", "string", "binary", "struct"])
def test_components_by_rounds_and_by_a_last_task_are_those_of_plain_search(spark, kind):
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 300, (200, 2)).tolist() + [[299, i] for i in range(40)] + [[400 - i, 401 - i] for i in range(50)]
    group = {i: {i} for p in pairs for i in p}
    for a, b in pairs:
        group[a] |= group[b]
        for i in group[a]:
            group[i] = group[a]
    as_kind = {"string": F.format_string("n%05d", "id"), "binary": F.unhex(F.format_string("%08x", "id")), "struct": F.struct(F.col("id").alias("i"))}
    node = as_kind[kind] if kind in as_kind else F.col("id").cast(kind)
    ids = spark.createDataFrame([(i,) for i in sorted(group)], "id long").select("id", node.alias("node"))
    known = {r.id: r.node for r in ids.collect()}
    kinds = ids.schema["node"].dataType.simpleString()
    edges = spark.createDataFrame([(known[a], known[b]) for a, b in pairs], f"src {kinds}, dst {kinds}")
    plain = {known[i]: known[min(g)] for i, g in group.items()}
    for last_edges in (0, 60, graph.LAST_EDGES):  # rounds alone, rounds and then a last task, the task alone
        assert {r.node: r.component for r in graph.connected_components(edges, last_edges=last_edges).collect()} == plain


def test_nearest_and_radius(spark, cloud):
    left = spark.createDataFrame(cloud)
    right = spark.createDataFrame(cloud[cloud.point_id % 40 == 0].rename(columns={"point_id": "ground_id"}))
    target = cloud[cloud.point_id % 40 == 0]
    for r in spatial.nearest(left, right).collect():
        p = cloud.iloc[r.point_id]
        assert math.isclose(r.distance, float(np.hypot(target.x - p.x, target.y - p.y).min()), abs_tol=1e-9)
    counts = {r.point_id: r.n_near for r in spatial.radius_count(left, 2.0).collect()}
    for p in cloud.itertuples():
        assert counts[p.point_id] == int(((cloud.x - p.x) ** 2 + (cloud.y - p.y) ** 2 <= 4.0).sum()) - 1


def test_nearest_without_targets(spark, cloud):
    none = spark.createDataFrame([], "ground_id long, x double, y double")
    assert spatial.nearest(spark.createDataFrame(cloud), none).count() == 0


def test_every_point_has_one_core_tile(spark, cloud):
    tiles = grid.tile_rows(spark.createDataFrame(cloud), 7.0, 1.5)
    assert tiles.where("is_core").groupBy("point_id").count().where("count = 1").count() == len(cloud)
    assert tiles.select("point_id", "tile_i", "tile_j").distinct().count() == tiles.count()


def test_smoothing_equals_dense(spark):
    a = np.random.default_rng(2).uniform(0, 9, (11, 14))
    cells = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(11) for c in range(14)], "row int, col int, value double")
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    w /= w.sum()
    padded = np.pad(a, 4, mode="symmetric")
    rows = sum(w[k] * padded[k : k + 11] for k in range(9))
    want = sum(w[k] * rows[:, k : k + 14] for k in range(9))
    for r in segments.smoothed(cells).collect():
        assert math.isclose(r.value, want[r.row, r.col], abs_tol=1e-9)


def test_watershed_by_tiles_equals_whole(spark):
    a = np.random.default_rng(3).uniform(1, 9, (12, 12))
    table = pd.DataFrame([(r, c, a[r, c]) for r in range(12) for c in range(12)], columns=["row", "col", "value"]).astype({"row": "int32", "col": "int32"})
    seeds = spark.createDataFrame([(2, 2, 1), (9, 8, 2)], "row int, col int, label long")
    got = segments.watershed(spark.createDataFrame(table), seeds, tile=5, halo=20).toPandas().sort_values(["row", "col"])
    want = segments.watershed_kernel(table.row.to_numpy(), table.col.to_numpy(), table.value.to_numpy(), {(2, 2): 1, (9, 8): 2})
    assert (got.label.to_numpy() == want).all()


@pytest.mark.parametrize("values", [np.random.default_rng(3).uniform(1, 9, (24, 24)), np.random.default_rng(3).integers(1, 4, (24, 24)).astype(float), np.add.outer(np.zeros(24), np.arange(24.0, 0, -1))])
def test_watershed_keeps_negative_labels_and_long_floods(spark, values):
    table = pd.DataFrame([(r, c, values[r, c]) for r in range(24) for c in range(24)], columns=["row", "col", "value"]).astype({"row": "int32", "col": "int32"})
    seeds = {(3, 0): -5, (20, 1): 7, (12, 2): 0}
    got = segments.watershed(spark.createDataFrame(table), spark.createDataFrame([(r, c, n) for (r, c), n in seeds.items()], "row int, col int, label long"), tile=6, halo=1).toPandas().sort_values(["row", "col"])
    want = segments.watershed_kernel(table.row.to_numpy(), table.col.to_numpy(), table.value.to_numpy(), seeds)
    assert len(got) == len(want) and (got.label.to_numpy() == want).all() and set(got.label) == {-5, 0, 7}


def test_flood_drains_and_flow_counts_all(spark):
    a = np.random.default_rng(4).uniform(0, 5, (10, 10))
    table = pd.DataFrame([(1, r, c, a[r, c]) for r in range(10) for c in range(10)], columns=["site", "row", "col", "value"]).astype({"row": "int32", "col": "int32"})
    flooded = terrain.priority_flood(spark.createDataFrame(table), "site").cache()
    low = {(r.row, r.col): r.value for r in flooded.collect()}
    assert all(low[k] >= a[k] for k in low)
    inner = [(r, c) for r in range(1, 9) for c in range(1, 9)]
    assert all(any(low[r + i, c + j] < low[r, c] for i in (-1, 0, 1) for j in (-1, 0, 1)) for r, c in inner)
    cells = flooded.select("row", "col", "value")
    pits = grid.d8(cells).where("direction is null").select("row", "col")
    assert terrain.flow_accumulation(cells).join(pits, ["row", "col"]).agg({"cells": "sum"}).first()[0] == 100


def test_ground_filter_keeps_ground(spark):
    rng = np.random.default_rng(6)
    high = rng.uniform(0, 1, 600) < 0.3
    points = pd.DataFrame({"point_id": range(600), "x": rng.uniform(0, 10, 600), "y": rng.uniform(0, 10, 600), "z": np.where(high, 6.0, 0.0) + rng.normal(0, 0.02, 600)})
    got = terrain.ground_points(spark.createDataFrame(points), 1.0).toPandas().set_index("point_id").is_ground
    assert not got[points.point_id[high]].any() and got[points.point_id[~high]].mean() > 0.95


@settings(max_examples=25, deadline=None)
@given(st.floats(0.08, 0.2), st.floats(-3, 3), st.floats(-3, 3), st.integers(0, 10**6))
def test_circle_is_recovered(radius, cx, cy, seed):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 2 * np.pi, 80)
    x, y = cx + radius * np.cos(t), cy + radius * np.sin(t)
    x[:4] += 0.08
    fit = circles.robust_circle(x, y)
    assert fit is not None and math.hypot(fit[0] - cx, fit[1] - cy) < 2e-3 and abs(fit[2] - radius) < 2e-3


def test_too_few_points_fit_no_circle():
    assert circles.robust_circle(np.zeros(5), np.zeros(5)) is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=30))
def test_hull_of_hulls(points):
    half = len(points) // 2
    parts = feed.convex_hull_kernel(points[:half]) + feed.convex_hull_kernel(points[half:])
    assert feed.convex_hull_kernel(parts) == feed.convex_hull_kernel(points)


def test_linearity_of_a_line():
    t = np.linspace(0, 1, 40)
    assert neighbours.line_share(np.stack([t, t, t], 1)[None]).min() > 0.999


def test_robust_mean_keeps_small_groups(spark):
    rows = [(1, 1.0), (1, 100.0), (2, 1.0), (2, 1.0), (2, 1.0), (2, 1.0), (2, 1.0), (2, 1.0), (2, 1.0), (2, 50.0), (3, None)]
    got = {r.g: (r.n, round(r.robust_mean, 6), r.n_dropped) for r in stats.robust_mean(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()}
    assert got == {1: (2, 50.5, 0), 2: (8, 1.0, 1)}


XML = """﻿<?xml version="1.0"?><ns:Production xmlns:ns="u:x"><ns:Machine machineCategory="H"><ns:MachineUserID>M7</ns:MachineUserID><ns:ObjectDefinition><ns:ObjectName>Wood 1</ns:ObjectName><ns:StartTime>2024-03-01T08:00:00</ns:StartTime></ns:ObjectDefinition>
<ns:SpeciesGroupDefinition><ns:SpeciesGroupKey>2</ns:SpeciesGroupKey><ns:SpeciesGroupName>Spruce</ns:SpeciesGroupName></ns:SpeciesGroupDefinition><ns:ProductDefinition><ns:ProductKey>9</ns:ProductKey><ns:ProductName>Sawlog</ns:ProductName></ns:ProductDefinition>
<ns:Stem><ns:StemKey>11</ns:StemKey><ns:StemNumber>3</ns:StemNumber><ns:SpeciesGroupKey>2</ns:SpeciesGroupKey><ns:StemCoordinates receiverPosition="Base"><ns:Latitude latitudeCategory="North">55.5</ns:Latitude><ns:Longitude longitudeCategory="West">3.25</ns:Longitude></ns:StemCoordinates>
<ns:SingleTreeProcessedStem><ns:DBH>312</ns:DBH><ns:StemDiameters><ns:DiameterValue diameterPosition="0">300</ns:DiameterValue><ns:DiameterValue diameterPosition="980">70</ns:DiameterValue></ns:StemDiameters>
<ns:Log><ns:LogKey>1</ns:LogKey><ns:ProductKey>9</ns:ProductKey><ns:LogLength>490</ns:LogLength><ns:LogVolume logVolumeCategory="m3sob">0.3</ns:LogVolume><ns:LogVolume logVolumeCategory="m3sub">0.25</ns:LogVolume></ns:Log>
<ns:Log><ns:LogKey>2</ns:LogKey><ns:ProductKey>8</ns:ProductKey><ns:LogLength>300</ns:LogLength><ns:LogVolume logVolumeCategory="m3sub">0.05</ns:LogVolume></ns:Log></ns:SingleTreeProcessedStem></ns:Stem></ns:Machine></ns:Production>"""


def test_harvester_file(spark):
    rows = feed.harvested_stems(feed.parsed_files(spark.createDataFrame([("a.hpr", XML), ("b.hpr", "<broken"), ("c.hpr", "")], "file_name string, content string"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.machine_id, r.object_name, r.species, r.assortment, r.longitude, r.latitude) == ("M7", "Wood 1", "Spruce", "Sawlog", -3.25, 55.5)
    assert [(x.start_cm, x.length_cm, x.volume_m3) for x in r.logs] == [(0.0, 490.0, 0.25), (490.0, 300.0, 0.05)]


def test_loading_twice_changes_nothing(spark):
    a = spark.createDataFrame([("f1", 1), ("f2", 2)], "file_name string, v int")
    b = spark.createDataFrame([("f2", 5), ("f3", 3)], "file_name string, v int")
    once = feed.replaced(a, b, ["file_name"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, feed.replaced(once, b, ["file_name"]).collect())) == [("f1", 1), ("f2", 5), ("f3", 3)]


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(8)
    x, y, z = rng.uniform(-50, 50, (3, 1000))
    data = sources.las_bytes(x, y, z, np.full(1000, 2))
    (tmp_path / "a.las").write_bytes(data)
    got = sources.read_las(spark, str(tmp_path), chunk=300).toPandas().sort_values("point_id")
    assert np.abs(got[["x", "y", "z"]].to_numpy() - np.stack([x, y, z], 1)).max() < 6e-4 and (got.classification == 2).all()
    (tmp_path / "a.las").write_bytes(data[:-10])
    with pytest.raises(Exception, match="shorter"):
        sources.read_las(spark, str(tmp_path)).count()


def test_ascii_grid_and_zip(spark, tmp_path):
    import zipfile

    text = "ncols 2\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2\n-9999 4\n"
    (tmp_path / "a.asc").write_text(text)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/c.asc", text)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    want = {(1, 0, 105.0, 215.0, 1.0), (1, 1, 115.0, 215.0, 2.0), (0, 1, 115.0, 205.0, 4.0)}
    assert {tuple(r)[1:] for r in sources.read_ascii_grid(spark, str(tmp_path)).collect()} == want
    cells = sources.ascii_cells(sources.read_tiles(spark, str(tmp_path)))
    assert cells.count() == 6 and {tuple(r)[1:] for r in cells.collect()} == want


def test_geojson_and_csv(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"id":"c1","properties":{"name":" A ","species":"ss"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}},{"id":"c2","properties":{},"geometry":null}]}'
    rows = sources.geojson_compartments(spark.createDataFrame([("f", doc), ("g", "bad")], "file string, value string")).collect()
    assert [(r.poly_id, r.ref, r.species, len(r.rings[0])) for r in rows] == [("c1", "A", "ss", 4)]
    (tmp_path / "t.csv").write_text("﻿x,y\n1,2\nna,3\n,4\n5,6\n")
    assert sources.read_loose_csv(spark, str(tmp_path / "t.csv"), ["x", "y"]).count() == 2
    assert sources.read_loose_csv(spark, str(tmp_path / "none.csv"), ["x", "y"]).count() == 0


def test_stage_order_and_cycles():
    assert stages.resolved(["slope", "unknown", "chm"]) == ["normalise", "dtm", "slope", "chm"]
    loop = {n: stages.Stage(n, (m,), lambda t, p: {}) for n, m in (("a", "b"), ("b", "a"))}
    with pytest.raises(ValueError, match="need each other"):
        stages.resolved(["a"], loop)


def test_stages_run(spark):
    rng = np.random.default_rng(9)
    n = 3000
    x, y = rng.uniform(0, 12, (2, n))
    crown = np.hypot(x - 6, y - 6) < 2
    z = 0.05 * x + rng.normal(0, 0.01, n) + np.where(crown & (rng.uniform(0, 1, n) < 0.6), 8 - np.hypot(x - 6, y - 6), 0)
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(n), "x": x, "y": y, "z": z}))
    made = stages.run(["treetops", "slope"], {"points": points}, {"treetops": {"apart": 3.0, "half": 2}})
    tops = made["treetops"].orderBy("height_m", ascending=False).first()
    assert abs(tops.x - 6) < 1 and abs(tops.y - 6) < 1 and 7 < tops.height_m < 9
    assert made["slope"].count() > 0

"""Counts without pairs, polygons by cells, and suppression by tiles, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyq.operators import neighbours, segments, spatial


@pytest.mark.parametrize("radius", [0.05, 1.0, 30.0, 1000.0])
def test_counts_are_exact(spark, radius):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 0.3, (500, 2)), rng.uniform(-40, 40, (200, 2)), np.full((40, 2), 3.25), np.arange(20)[:, None] * np.array([[0.05, 0.0]])])
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    d2 = ((xy[:, None, 0] - xy[None, :, 0]) ** 2) + ((xy[:, None, 1] - xy[None, :, 1]) ** 2)
    want = (d2 <= radius * radius).sum(1)
    found = neighbours.count_within(points, points, radius, leaf_rows=16)
    got = {r.point_id: r.n for r in found.collect()}
    assert [got[i] for i in range(len(xy))] == want.tolist()


def test_a_dense_cloud_forms_few_pairs(spark):
    """Within the radius of all others, only counts are added: no row meets another."""
    cloud = spark.range(60_000).select(F.col("id").alias("point_id"), (F.rand(1) * 0.5).alias("x"), (F.rand(2) * 0.5).alias("y"))
    got = spatial.radius_count(cloud, 1.0).agg(F.min("n_near"), F.max("n_near"), F.count("*")).first()
    assert tuple(got) == (59_999, 59_999, 60_000)


def test_counts_of_missing_places(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 0.5, 0.0)], "point_id long, x double, y double")
    assert sorted(map(tuple, spatial.radius_count(points, 1.0).select("point_id", "n_near").collect())) == [(1, 1), (2, 0), (3, 1)]
    assert spatial.radius_count(points.limit(0), 1.0).count() == 0


def star(rng, n, centre, radius):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.2, 1, n) * radius
    ring = np.stack([centre[0] + r * np.cos(angle), centre[1] + r * np.sin(angle)], 1).tolist()
    return [*ring, ring[0]]


@pytest.mark.parametrize("size", [7.0, 40.0, 500.0])
def test_polygons_by_cells(spark, size):
    rng = np.random.default_rng(9)
    shapes = [(k, k, [star(rng, int(rng.integers(3, 30)), rng.uniform(0, 300, 2), rng.uniform(10, 200))]) for k in range(12)]
    shapes.append((20, 20, [[[0.0, 0.0], [210.0, 0.0], [210.0, 210.0], [0.0, 210.0], [0.0, 0.0]], [[35.0, 35.0], [70.0, 35.0], [70.0, 70.0], [35.0, 70.0], [35.0, 35.0]]]))
    edges = spatial.ring_edges(spark.createDataFrame(shapes, "poly_id int, ordinal int, rings array<array<array<double>>>"))
    points = np.concatenate([rng.uniform(-50, 350, (400, 2)), np.stack(np.meshgrid(np.arange(0, 220, 17.5), np.arange(0, 220, 17.5)), -1).reshape(-1, 2)])
    got = {(r.point_id, r.poly_id) for r in spatial.inside(spark.createDataFrame(pd.DataFrame({"point_id": range(len(points)), "x": points[:, 0], "y": points[:, 1]})), edges, size).collect()}
    lines = [tuple(r) for r in edges.collect()]
    want = set()
    for i, (x, y) in enumerate(points):
        turns = {}
        for poly, _, x1, y1, x2, y2 in lines:
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                turns[poly] = turns.get(poly, 0) + 1
        want |= {(i, p) for p, n in turns.items() if n % 2}
    assert got == want and want


def test_cells_inside_hold_no_edges(spark):
    square = [(1, 1, [[[0.5, 0.5], [99.5, 0.5], [99.5, 99.5], [0.5, 99.5], [0.5, 0.5]]])]
    cover = spatial.polygon_cover(spatial.ring_edges(spark.createDataFrame(square, "poly_id int, ordinal int, rings array<array<array<double>>>")), 10.0)
    assert cover.where("edges is null").count() == 64 and cover.agg(F.max(F.size("edges"))).first()[0] <= 2


def greedy(tops, distance):
    kept = []
    for key, x, y, _ in sorted(tops, key=lambda t: (-t[3], t[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= distance * distance for _, a, b, _ in kept):
            kept.append((key, x, y, _))
    return {t[0] for t in kept}


@pytest.mark.parametrize("tile", [2.0, 9.0, None])
def test_suppression_is_greedy(spark, tile):
    rng = np.random.default_rng(11)
    tops = [(i, *map(float, rng.uniform(0, 25, 2)), float(rng.integers(1, 12))) for i in range(500)]
    df = spark.createDataFrame(tops, "tree_id long, x double, y double, height_m double")
    assert {r.tree_id for r in segments.suppressed(df, 1.5, tile=tile).collect()} == greedy(tops, 1.5)


def test_suppression_of_ten_thousand_tops_in_a_chain(spark, monkeypatch):
    rounds = []
    inner = segments.stored
    monkeypatch.setattr(segments, "stored", lambda df, name: rounds.append(name) or inner(df, name))
    tops = spark.range(10_000).select(F.col("id").alias("tree_id"), (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), (20_000.0 - F.col("id")).alias("height_m"))
    kept = segments.suppressed(tops, 1.5, tile=2500.0)
    assert kept.count() == 5000 and kept.where("tree_id % 2 = 1").isEmpty() and len(rounds) <= 6

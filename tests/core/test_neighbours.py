"""k nearest neighbours and local linearity against brute force, and what a block meets."""

import numpy as np
import pandas as pd
import pytest

from canopyq.operators import neighbours


def brute(left, right, k, dims, by, apart):
    out = {}
    for row in left.itertuples():
        others = [o for o in right.itertuples() if (by is None or o.grp == row.grp) and not (apart and o.point_id == row.point_id)]
        ranked = sorted((sum((getattr(row, c) - getattr(o, c)) ** 2 for c in dims), o.point_id) for o in others)[:k]
        out[row.point_id] = [p for _, p in ranked], [d**0.5 for d, _ in ranked]
    return out


def cloud(n, seed, groups=3):
    rng = np.random.default_rng(seed)
    xyz = np.concatenate([rng.normal(0, 1, (n // 2, 3)), rng.normal(50, 0.01, (n // 4, 3)), rng.uniform(-500, 500, (n - n // 2 - n // 4 - 5, 3)), np.full((5, 3), 7.0)])
    return pd.DataFrame({"point_id": rng.permutation(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "grp": rng.integers(0, groups, n)})


@pytest.mark.parametrize("k,dims,by,apart", [(1, ("x", "y"), None, False), (5, ("x", "y"), "grp", True), (4, ("x", "y", "z"), None, True), (300, ("x",), "grp", False)])
def test_equal_to_brute_force(spark, k, dims, by, apart):
    left, right = cloud(300, 1), cloud(260, 2)
    right = left if apart else right
    found = neighbours.k_nearest(spark.createDataFrame(left), spark.createDataFrame(right), k, dims, by, "point_id", "point_id", apart, leaf_rows=16)
    got = {r.point_id: (list(r["keys"]), list(r.distances)) for r in found.collect()}
    want = brute(left, right, k, dims, by, apart)
    assert got.keys() == want.keys()
    for p in want:
        assert got[p][0] == want[p][0] and np.allclose(got[p][1], want[p][1], rtol=0, atol=1e-9)


def test_a_far_cluster_is_not_met_row_by_row(spark):
    """Rows in the void meet a few leaves of a dense cluster far away, not all of it."""
    rng = np.random.default_rng(4)
    cluster = pd.DataFrame({"ground_id": np.arange(40000), "x": rng.uniform(0, 1, 40000), "y": rng.uniform(0, 1, 40000)})
    void = pd.DataFrame({"point_id": np.arange(50), "x": rng.uniform(900, 1000, 50), "y": rng.uniform(900, 1000, 50)})
    a, b = (neighbours.Pyramid(neighbours._prepared(spark.createDataFrame(t), ("x", "y"), None, key, ()), [0.0, 0.0], 1000.0, 20, 256) for t, key in ((void, "point_id"), (cluster, "ground_id")))
    wanted = neighbours._wanted(a, b, 2, 1)[0].join(b.rows, "leaf").groupBy("block").count().toPandas()
    assert len(wanted) == 50 and wanted["count"].max() < 4000
    got = neighbours.k_nearest(spark.createDataFrame(void), spark.createDataFrame(cluster), 1).collect()
    for r in got:
        d = np.hypot(cluster.x - void.x[r.point_id], cluster.y - void.y[r.point_id])
        assert r["keys"] == [int(d.idxmin())]


def test_missing_and_empty(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0)], "point_id long, x double, y double")
    right = spark.createDataFrame([(9, 3.0, 4.0), (8, None, 0.0)], "ground_id long, x double, y double")
    assert [tuple(r) for r in neighbours.k_nearest(left, right, 2).collect()] == [(1, [9], [5.0])]
    assert [tuple(r) for r in neighbours.k_nearest(left, right.limit(0), 2).collect()] == [(1, [], [])]
    assert neighbours.k_nearest(left.limit(0), right, 2).count() == 0


def test_linearity_of_each_point(spark):
    points = cloud(400, 7, 4)
    got = {r.point_id: r.linearity for r in neighbours.linearity(spark.createDataFrame(points), "grp", k=8, leaf_rows=32).collect()}
    xyz = points[["x", "y", "z"]].to_numpy()
    for i, row in enumerate(points.itertuples()):
        if row.grp == 0:
            assert got[row.point_id] == 0
            continue
        others = [(((xyz[i] - xyz[j]) ** 2).sum(), p, j) for j, (p, g) in enumerate(zip(points.point_id, points.grp, strict=True)) if g == row.grp and j != i]
        near = xyz[[j for _, _, j in sorted(others)[:8]]]
        values = np.linalg.eigvalsh(np.cov(near.T))
        assert abs(got[row.point_id] - (values[2] - values[1]) / (values[2] + 1e-9)) < 1e-6

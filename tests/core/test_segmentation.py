"""The whole segmentation against a plain numpy version of its steps."""

import heapq

import numpy as np
import pandas as pd
import pytest

from canopyq.operators import circles, neighbours, segmentation, segments, spatial, stems

RULES = segmentation.SegmentRules(size=0.5, apart=1.2, density_radius=0.25, radius=0.35, neighbours=8)


def forest():
    rng = np.random.default_rng(4)
    parts = []
    for k, (cx, cy, h) in enumerate([(3.0, 3.0, 14.0), (8.5, 3.5, 17.0), (4.0, 9.0, 12.5), (10.0, 10.0, 16.0)]):
        z = np.arange(0.3, h, 0.08)
        angle = rng.uniform(0, 2 * np.pi, (len(z), 6))
        r = 0.15 + 0.3 * (k == 3) * rng.uniform(size=angle.shape)
        parts.append(np.stack([cx + (r * np.cos(angle)).ravel(), cy + (r * np.sin(angle)).ravel(), np.repeat(z, 6)], 1))
        crown = rng.normal(0, 1.0, (1500, 2))
        parts.append(np.column_stack([cx + crown[:, 0], cy + crown[:, 1], h - np.hypot(crown[:, 0], crown[:, 1]) * 1.5]))
    parts.append(np.column_stack([rng.uniform(0, 12, (300, 2)), rng.uniform(0.2, 5.5, 300)]))
    cloud = np.concatenate(parts)
    return cloud[cloud[:, 2] > 0]


def gaussian(a, sigma=1.0, half=4):
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        p = np.pad(a.astype(float), [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = sum(w[k] * np.take(p, range(k, k + a.shape[axis]), axis) for k in range(2 * half + 1)).astype(np.float32)
    return a


def plain(cloud, r):
    x, y, z = cloud.T
    x0, y0 = x.min(), y.min()
    cols, rows = np.floor((x - x0) / r.size).astype(int), np.floor((y - y0) / r.size).astype(int)
    canopy = np.zeros((rows.max() + 1, cols.max() + 1), np.float32)
    np.maximum.at(canopy, (rows, cols), z.astype(np.float32))
    smooth = gaussian(canopy)
    pad = np.pad(smooth, 1)
    top = np.max([pad[1 + a : pad.shape[0] - 1 + a, 1 + b : pad.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
    found = sorted(zip(*np.nonzero((smooth == top) & (smooth >= r.least)), strict=True), key=lambda c: (-smooth[c], c))
    kept = []
    for c in found:
        if all(np.hypot(c[0] - d[0], c[1] - d[1]) * r.size >= r.apart for d in kept):
            kept.append(c)
    kept.sort()
    tops = [(col * r.size + x0, row * r.size + y0) for row, col in kept]
    heights = [z[(x - a) ** 2 + (y - b) ** 2 <= r.size**2].max(initial=-1) for a, b in tops]
    label, heap = np.zeros(smooth.shape, int), []
    for k, c in enumerate(kept):
        label[c] = k + 1
        heapq.heappush(heap, (-float(smooth[c]), 0, *map(int, c)))
    while heap:
        _, steps, i, j = heapq.heappop(heap)
        for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            n = i + a, j + b
            if 0 <= n[0] < smooth.shape[0] and 0 <= n[1] < smooth.shape[1] and not label[n] and smooth[n] >= r.least:
                label[n] = label[i, j]
                heapq.heappush(heap, (-float(smooth[n]), steps + 1, *n))

    def cleared(ids):
        return np.where(np.bincount(ids, minlength=len(kept) + 1)[ids] < r.least_points, 0, ids)

    band = (z >= r.low) & (z <= r.high)
    xyz, ids = cloud[band], cleared(label[rows[band], cols[band]])
    raw = np.bincount(ids, minlength=len(kept) + 1)
    near = (((xyz[:, None, :2] - xyz[None, :, :2]) ** 2).sum(2) <= r.density_radius**2).sum(1) - 1
    xyz, ids = xyz[near >= r.density_least], cleared(ids[near >= r.density_least])
    dense, out = np.bincount(ids, minlength=len(kept) + 1), []
    for k, (a, b) in enumerate(tops):
        pts = xyz[ids == k + 1]
        row = {"tree_id": k + 1, "canopy_height_m": heights[k], "n_points_raw": raw[k + 1] if k + 1 else 0, "n_points_after_density": dense[k + 1], "crown_n_pixels": (label == k + 1).sum()}
        if len(pts):
            values = np.linalg.eigvalsh(np.cov(pts.T))
            centroids = [pts[(pts[:, 2] >= q) & (pts[:, 2] < q + 0.5), :2] for q in np.arange(pts[:, 2].min(), pts[:, 2].max(), 0.5)]
            centroids = np.array([c.mean(0) for c in centroids if len(c) >= 5])
            drift = np.hypot(*np.diff(centroids, axis=0).T) if len(centroids) > 1 else np.array([np.nan])
            keep = np.hypot(pts[:, 0] - a, pts[:, 1] - b) <= r.radius
            keep = keep if keep.sum() >= r.radius_least else np.ones(len(pts), bool)
            left = pts[keep]
            scores = np.full(len(left), 0.5)
            if len(left) > r.neighbours:
                d = ((left[:, None] - left[None]) ** 2).sum(2)
                np.fill_diagonal(d, np.inf)
                for i, order in enumerate(np.argsort(d, axis=1, kind="stable")[:, : r.neighbours]):
                    v = np.linalg.eigvalsh(np.cov(left[order].T))
                    scores[i] = (v[2] - v[1]) / (v[2] + 1e-9)
            row |= {"pca_linearity": (values[2] - values[1]) / values[2], "mean_centroid_drift_m": drift.mean(), "n_centroid_slices": len(centroids), "radial_n_before": len(pts), "radial_n_removed": (~keep).sum(), "n_points_final": (scores >= r.linearity).sum()}
        out.append(row)
    return out


def test_chain_is_the_plain_one(spark):
    cloud = forest()
    made = segmentation.segment_trees(spark.createDataFrame(pd.DataFrame(cloud, columns=["x", "y", "z"])), RULES)
    got = {r.tree_id: r.asDict() for r in made["segment_summary"].collect()}
    want = plain(cloud, RULES)
    assert sorted(got) == [w["tree_id"] for w in want] and len(want) >= 4
    for w in want:
        g = got[w["tree_id"]]
        for k, v in w.items():
            assert g[k] == pytest.approx(v, abs=1e-6, nan_ok=True), (w["tree_id"], k)
        if "pca_linearity" not in w:
            assert (g["segment_status"], g["seed_status"], g["segment_qc_tier"], g["failures"]) == ("rejected_before_scoring", "not_scored", "failed", None)
    assert any("pca_linearity" in w for w in want) and any(w.get("radial_n_removed") for w in want)
    assert made["segment_points"].count() == sum(w.get("n_points_final", 0) for w in want)


def test_chain_of_nothing(spark):
    made = segmentation.segment_trees(spark.createDataFrame([], "x double, y double, z double"))
    assert all(t.count() == 0 for t in made.values())


def test_axes_by_closed_form(spark):
    """Variances 5, 3 and 2 along the axes: (l1 - l2) / l1 is 0.4."""
    rows = [(1, *p) for axis, v in enumerate((3, 2, 5)) for s in (-1, 1) for p in [tuple(s * (v * 2.5) ** 0.5 if k == axis else 0.0 for k in range(3))]]
    r = segments.principal_axes(spark.createDataFrame(rows, "tree_id long, x double, y double, z double"), "tree_id").first()
    assert r.linearity == pytest.approx(0.4) and r.verticality == pytest.approx(1.0)


def test_empty_segments_are_rejected(spark):
    rows = [(1, 0, None, None, None, None, None), (2, None, None, None, None, None, None), (3, 40, 0.9, 0.9, 5, 0.1, 0.1)]
    got = segments.segment_scores(spark.createDataFrame(rows, "tree_id long, n_points long, linearity double, verticality double, n_slices long, drift_mean double, drift_max double")).orderBy("tree_id").collect()
    assert [(r.failures, r.fail_reasons, r.segment_status, r.segment_qc_tier) for r in got[:2]] == [(3, "empty_after_density_filter", "rejected_after_scoring", "failed")] * 2
    assert got[2].segment_status == "good_candidate"


def test_drift_from_the_lowest_point(spark):
    rows = [(1, float(k // 8), 0.0, 0.3125 + 0.0625 * k) for k in range(32)] + [(1, 99.0 + k, 0.0, 2.3125) for k in range(6)]  # the highest begin no slice
    r = stems.centroid_drift(spark.createDataFrame(rows, "tree_id long, x double, y double, z double"), ["tree_id"], from_lowest=True).first()
    assert (r.n_slices, r.drift_mean) == (4, pytest.approx(1.0))


def test_chain_of_copies_is_the_plain_one(spark, monkeypatch):
    """Each place holds one to three points and every eleventh ten: more than a point has neighbours."""
    cloud = forest()
    copied = np.repeat(cloud, np.where(np.arange(len(cloud)) % 11 == 0, 10, np.arange(len(cloud)) % 3 + 1), axis=0)
    monkeypatch.setitem(globals(), "forest", lambda: copied)
    test_chain_is_the_plain_one(spark)


def test_copies_cost_no_rows(spark, monkeypatch):
    """Sixty points in each place are as many rows as one, in every table on the way, and come back as points at its end."""
    rows, plain_stored = {}, segmentation.stored

    def counted(df, name):
        out = plain_stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(segmentation, "stored", counted)
    rules = segmentation.SegmentRules(size=0.5, apart=1.2, density_radius=0.25, density_least=60, radius=0.35, neighbours=80, linearity=0.0)
    cloud = forest()
    one = spark.createDataFrame(pd.DataFrame(cloud, columns=["x", "y", "z"]))
    made = segmentation.segment_trees(one.withColumn("copy", segmentation.F.explode(segmentation.F.sequence(segmentation.F.lit(1), segmentation.F.lit(60)))).drop("copy"), rules)
    assert rows["cloud"] == len(cloud) and rows["band"] < len(cloud)
    assert made["segment_points"].count() == sum(r.n_points_final for r in made["segment_summary"].collect()) > rows["final"]


def test_only_sparse_cells_are_counted(spark, monkeypatch):
    """A cloud that is dense everywhere is told by its cells: no row meets another."""
    monkeypatch.setattr(spatial, "count_within", lambda *a, **k: pytest.fail("rows were counted"))
    grid = spark.range(40_000).selectExpr("id AS point_id", "id % 200 * 0.01 AS x", "floor(id / 200) * 0.01 AS y")
    assert spatial.crowded(grid.where("x < 1.4 and y < 1.4"), 0.2, 20).count() > 19_000


@pytest.mark.parametrize("least", [1, 3, 9])
@pytest.mark.parametrize("radius", [0.05, 0.4, 30.0])
def test_crowded_is_the_count(spark, radius, least):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(0, 0.3, (400, 2)), rng.uniform(-40, 40, (200, 2)), np.arange(30)[:, None] * np.array([[0.05, 0.0]]), [[np.nan, 0.0], [np.inf, 0.0], [0.0, -np.inf]]])
    number = np.where(np.arange(len(xy)) % 7 == 0, 5, 1)
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "copies": number}))
    with np.errstate(invalid="ignore"):
        near = (((xy[:, None] - xy[None]) ** 2).sum(2) <= radius * radius) @ number - 1
    got = spatial.crowded(points, radius, least, "copies")
    assert got.columns == points.columns
    assert sorted(r.point_id for r in got.collect()) == np.flatnonzero(near >= least).tolist()


@pytest.mark.parametrize("whole_rows", [0, 40, 100])
def test_linearity_of_copies(spark, whole_rows):
    """Places with their numbers score as their points do, among them places of more points than are asked for."""
    rng = np.random.default_rng(5)
    places = pd.DataFrame(rng.normal(0, 1, (90, 3)), columns=["x", "y", "z"]).assign(tree_id=[1] * 60 + [2] * 29 + [3], point_id=range(90), copies=[1, 2, 3, 9, 4, 1] * 15)
    each = places.loc[places.index.repeat(places["copies"])].assign(place=lambda d: d["point_id"], point_id=range(places["copies"].sum()))
    want = {r.place: r.linearity for r in neighbours.linearity(spark.createDataFrame(each), "tree_id", k=8, leaf_rows=16, whole_rows=0).join(spark.createDataFrame(each[["point_id", "place"]]), "point_id").collect()}
    for some in (places, places[places["copies"] <= 8], places[places["copies"] > 8]):
        got = {r.point_id: r.linearity for r in neighbours.linearity(spark.createDataFrame(some), "tree_id", k=8, leaf_rows=16, copies="copies", whole_rows=whole_rows).collect()}
        assert sorted(got) == sorted(some["point_id"])
        if some is places:
            assert got == pytest.approx(want, abs=1e-9)


def test_circles_of_copies(spark):
    rng = np.random.default_rng(8)
    angle = rng.uniform(0, 2 * np.pi, 40)
    x, y, number = 5 + 0.2 * np.cos(angle) + rng.normal(0, 0.01, 40), 7 + 0.2 * np.sin(angle), rng.integers(1, 6, 40)
    assert circles.seed_circle(x, y, number) == pytest.approx(circles.seed_circle(np.repeat(x, number), np.repeat(y, number)), abs=1e-9)
    assert circles._median(x, number) == pytest.approx(float(np.median(np.repeat(x, number))), abs=1e-12)


@pytest.mark.parametrize("k", [1, 4, 20])
def test_nearest_in_a_whole_tree(k):
    """Parts of a tree find what all of it holds, ties and equal places too."""
    rng = np.random.default_rng(k)
    xyz = np.concatenate([rng.normal(0, 1, (700, 3)), np.round(rng.uniform(0, 3, (500, 3))), rng.normal(50, 0.01, (300, 3)), [[900.0, 0, 0]]])[rng.permutation(1501)]
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    asking = rng.uniform(size=len(xyz)) < 0.7
    want = np.where(asking[:, None], np.argsort(d, axis=1, kind="stable")[:, :k], -1)
    assert (neighbours.nearest_others(xyz, asking, k) == want).all()
    few = neighbours.nearest_others(xyz[:3], np.ones(3, bool), 4)
    assert (np.sort(few, 1)[:, :2] == -1).all() and (few[:, :2] >= 0).all()

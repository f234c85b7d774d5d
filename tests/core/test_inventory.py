"""Operators of the inventory that SQL doesn't cover, or not wholly."""

import colorsys
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyq.functions import scalar as S
from canopyq.operators import circles, feed, spatial, stats, tariff
from canopyq.plans import stages


def test_palettes(spark):
    n = 17
    got = spark.range(n).select("id", S.palette_colour(F.col("id"), F.lit(n)).alias("p"), S.golden_colour(F.col("id")).alias("g")).orderBy("id").collect()
    for r in got:
        i = r.id
        palette = colorsys.hsv_to_rgb(i / n, 0.9 if i % 2 == 0 else 0.6, 0.9 if i % 3 else 0.7)
        golden = colorsys.hsv_to_rgb(i * 0.6180339887498949 % 1, 1, 1)
        assert all(abs(a - b * 65535) <= 1.01 for a, b in zip(r.p + r.g, palette + golden, strict=True))


def test_path_keys(spark):
    paths = ["a/b", "/a/b", "s3://store/a/b", "s3://store", "https://store.s3.amazonaws.com/a/b", " / ", "", None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", S.path_key(F.col("p")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == ["a/b", "a/b", "a/b", None, "a/b", None, None, None]


def ring(n, cx, cy, r, seed, noise=0.002):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 2 * math.pi, n)
    d = r + rng.normal(0, noise, n)
    return cx + d * np.cos(a), cy + d * np.sin(a)


def test_seeds(spark):
    parts = []
    for tree, (cx, cy, r, slices) in {1: (1.0, 2.0, 0.15, 6), 2: (5.0, 5.0, 0.2, 2), 0: (9.0, 9.0, 0.1, 6), 3: (20.0, 20.0, 0.9, 6)}.items():
        for k in range(slices):
            x, y = ring(40, cx, cy, r, tree * 10 + k)
            parts.append(pd.DataFrame({"tree_id": tree, "x": x, "y": y, "z": 0.6 + 0.2 * k}))
    points = spark.createDataFrame(pd.concat(parts))
    trees = spark.createDataFrame([(1, 240), (2, 80), (3, 240), (4, 0)], "tree_id long, n_points long")
    got = {r.tree_id: r for r in circles.seeds(trees, circles.seed_fits(points)).collect()}
    assert [got[i].seed_status for i in (1, 2, 3, 4)] == ["seed_ok", "insufficient_seed_slices", "insufficient_seed_slices", "empty_tree"]
    assert got[1].seed_n_slices == 6 and got[2].seed_n_slices == 2 and got[3].seed_n_slices == 0 and got[2].seed_cx is None
    assert np.allclose([got[1].seed_cx, got[1].seed_cy, got[1].seed_r_m], [1, 2, 0.15], atol=0.003)


def test_numbering_of_an_empty_table_and_null_blocks(spark):
    rows = spark.createDataFrame([(None, 2), (1, 1), (None, 1), (0, 5)], "b int, o int")
    got = {(r.b, r.o): r.n for r in stats.numbered(rows, ["b"], ["o"], "n").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (0, 5): 3, (1, 1): 4}
    assert stats.strided(rows.limit(0), 10, ["b"], ["o"]).count() == 0
    with pytest.raises(ValueError, match="missing columns: x"):
        stats.required(rows, {"b", "x"})


def test_volumes_of_site_use_species(spark):
    tops = spark.createDataFrame([(i, 5.0 + i % 2 * 100, 5.0, 20.0 + i % 3) for i in range(1, 21)], "tree_id long, x double, y double, height_m double")
    sizes = spark.createDataFrame([(i, None, 20.0 + i % 5, "good", 0.9) for i in range(1, 22)], "tree_id long, height_m double, dbh_cm double, dbh_status string, dbh_confidence double")
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    edges = spark.createDataFrame([(p, p, a[0] + dx, a[1], b[0] + dx, b[1]) for p, dx in ((1, 0.0), (2, 100.0)) for a, b in zip(square[:-1], square[1:], strict=True)], "poly_id int, ordinal int, x1 double, y1 double, x2 double, y2 double")
    kinds = spark.createDataFrame([(1, "Douglas Fir"), (2, "european larch")], "compartment int, species string")
    got = {r.tree_id: r for r in tariff.volumes_of_site(tops, sizes, None, edges, kinds, 50.0).collect()}
    assert len(got) == 21 and got[21].compartment is None and got[2].compartment == 1 and got[3].compartment == 2
    same = {r.tree_id: r for r in tariff.volumes_of_site(tops, sizes, None, edges, kinds.withColumn("species", F.lit("oak")), 50.0).collect()}
    assert got[2].volume_m3 > same[2].volume_m3 and got[3].volume_m3 < same[3].volume_m3


def test_site_cascade_and_rematch(spark):
    objects = spark.createDataFrame([(1, "Oakwood"), (2, "Nowhere"), (3, "New place"), (4, ""), (5, "NEW  PLACE")], "object_id long, name string")
    sites = spark.createDataFrame([(10, 1, "Oakwood", "A1"), (11, 2, "Elmfield", "B2")], "site_id long, ordinal int, name string, code string")
    points = spark.createDataFrame([(2, i, 1.0 + i, 1.5 + i) for i in range(4)], "object_id long, point_id long, x double, y double")
    edges = spark.createDataFrame([(11, 1, 0.0, 0.0, 9.0, 0.0), (11, 1, 9.0, 0.0, 9.0, 9.0), (11, 1, 9.0, 9.0, 0.0, 9.0), (11, 1, 0.0, 9.0, 0.0, 0.0)], "poly_id int, ordinal int, x1 double, y1 double, x2 double, y2 double")
    found = spatial.site_cascade(objects, sites, points, edges, 5.0, S.match_key, create=True)
    got = {r.object_id: r for r in found.collect()}
    assert [got[i].matched_by for i in range(1, 6)] == ["name", "gps", "created", "none", "created"]
    assert got[1].site_id == 10 and got[2].site_id == 11 and got[3].site_id == got[5].site_id < 0 and got[4].site_id is None
    kept = {r.object_id: r.matched_by for r in spatial.site_cascade(objects, sites, points, edges, 5.0, S.match_key).collect()}
    assert kept[3] == "none" and kept[2] == "gps"
    rows = [(1, "hpr", "parsed", None, None, None), (2, "hpr", "parsed", 99, 7, "name"), (3, "mom", "parsed", None, None, None), (4, "hpr", "parsed", None, None, None)]
    files = spark.createDataFrame(rows, "object_id long, file_type string, parse_status string, site_id long, operation_id long, matched_by string")
    operations = spark.createDataFrame([(10, 5, "planned")], "site_id long, operation_id long, status string")
    after = {r.object_id: tuple(r)[3:] for r in feed.rematched(files, found, operations).collect()}
    assert after == {1: (10, 5, "name"), 2: (99, 7, "name"), 3: (None, None, None), 4: (None, None, None)}
    assert {r.object_id for r in feed.unassigned(files).collect()} == {1, 4}


def test_one_failing_type_leaves_the_others(spark):
    def broken():
        raise OSError("not enabled")

    listed, errors = feed.listed_by_type({"hpr": lambda: spark.createDataFrame([("a",)], "file_name string"), "mom": broken})
    assert [tuple(r) for r in listed.collect()] == [("a", "hpr")] and errors == {"mom": "not enabled"}
    assert feed.listed_by_type({"mom": broken})[0] is None


def test_segments_stage(spark):
    rng = np.random.default_rng(4)
    parts = []
    for cx, cy, h in ((5.0, 5.0, 12.0), (15.0, 6.0, 14.0)):
        for z in np.arange(0.5, h, 0.1):
            x, y = ring(12, cx, cy, 0.15, int(z * 100))
            parts.append(pd.DataFrame({"x": x, "y": y, "z": z}))
        crown = rng.normal(0, 0.8, (600, 2))
        far = np.hypot(crown[:, 0], crown[:, 1])
        parts.append(pd.DataFrame({"x": cx + crown[:, 0], "y": cy + crown[:, 1], "z": h - far * 2}))
    heights = spark.createDataFrame(pd.concat(parts)).where("z > 0")
    spark.conf.set("canopyq.segments.least_points", "25")
    try:
        assert stages.overrides(spark, stages.STAGES["segments"]) == {"least_points": 25}
        tables = {"heights": heights}
        stage = stages.STAGES["segments"]
        tables |= {k: v.cache() for k, v in stage.make(tables, {**stage.parameters, "apart": 3.0, "density_radius": 0.3}).items()}
        summary = tables["segment_summary"].orderBy("tree_id").collect()
    finally:
        spark.conf.unset("canopyq.segments.least_points")
    assert [r.tree_id for r in summary] == list(range(1, len(summary) + 1))
    tall = [r for r in summary if r.seed_status == "seed_ok"]
    assert len(tall) == 2 and all(0 < r.n_points_final <= r.n_points_after_density <= r.n_points_raw for r in tall)
    assert all(min(abs(r.seed_cx - 5.0), abs(r.seed_cx - 15.0)) < 0.2 for r in tall)

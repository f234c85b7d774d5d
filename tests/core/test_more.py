"""Operators and functions without a registered query."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from canopyq.functions import scalar as S
from canopyq.operators import circles, feed, grid, harvest, segments, spatial, stems
from canopyq.sources import files as sources
from canopyq.streaming import feed_stream


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    r = one(spark, half=S.round_half_up(F.lit(-2.5)), even=S.round_half_even(F.lit(2.5)), cell=S.cell_of(F.lit(-0.1), 1.0), turn=S.bearing(F.lit(-1.0), F.lit(0.0)), red=S.hue_colour(F.lit(0.0)), green=S.hue_colour(F.lit(1 / 3)), ring=S.hex_ring(F.lit(0), F.lit(0), 25.0), south=S.aspect_degrees(F.lit(0.0), F.lit(1.0)))
    assert (r.half, r.even, r.cell, r.turn, r.south) == (-2.0, 2.0, -1, 270.0, 180.0)
    assert r.red == [65535, 0, 0] and r.green[1] == 65535 and r.green[0] < 2
    assert len(r.ring) == 7 and r.ring[0] == r.ring[6]
    area = 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r.ring[:-1], r.ring[1:], strict=True)))
    assert math.isclose(area, 25.0, rel_tol=1e-9)
    t = one(spark, v=S.tariff_volume(F.lit(30.0), S.basal_area(F.lit(25.0))), e=S.web_mercator(F.lit(0.0), F.lit(180.0))[0])
    back = one(spark, t=S.tariff_number(F.lit(t.v), S.basal_area(F.lit(25.0))))
    assert math.isclose(back.t, 30.0, rel_tol=1e-9) and math.isclose(t.e, math.pi * 6378137.0)


def test_points_by_tile(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(500), "x": rng.uniform(0, 50, 500), "y": rng.uniform(0, 50, 500)}))
    sources.clustered_points(points, str(tmp_path / "t"), 10.0)
    got = sources.points_in_bounds(spark, str(tmp_path / "t"), 10.0, 5, 5, 25, 15)
    assert {r.point_id for r in got.collect()} == {r.point_id for r in points.where("x >= 5 and x < 25 and y >= 5 and y < 15").collect()}
    assert "PartitionFilters: [isnotnull(tile_i" in got._jdf.queryExecution().executedPlan().toString()
    assert sources.thinned(points, 1000).count() == 500 and 50 < sources.thinned(points, 100).count() < 160


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    sources.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    sources.replace_partitions(spark.createDataFrame([(3, "b")], "v int, k string"), path, ["k"])
    assert sorted((r.v, r.k) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_file_probes(spark):
    files = spark.createDataFrame([("s3/a.copc.laz", b"x"), ("b.las", b"LASF" + b"\0" * 300 + b"copc"), ("c.las", b"LASF" + b"\0" * 300)], "path string, content binary")
    assert [r.is_copc for r in sources.is_octree_file(files).orderBy("path").collect()] == [True, False, True]
    refs = spark.createDataFrame([("nn12",)], "tile_ref string")
    assert sources.tiles_for(spark.createDataFrame([("d/NN12_5.asc",), ("d/NN13_5.asc",)], "path string"), refs).count() == 1


def test_schedule_and_hull(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = spark.sql("SELECT 1 id, true active, timestamp'2024-01-01 11:00:00' next_run_at, 6 interval_hours UNION ALL SELECT 2, true, timestamp'2024-01-01 13:00:00', 6 UNION ALL SELECT 3, false, null, 6")
    assert [(r.id, str(r.next_run_at)) for r in feed.due(rows, now).collect()] == [(1, "2024-01-01 18:00:00")]
    assert {r.id for r in feed.due(rows, now, forced=True).collect()} == {1, 2}
    hull = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 2D)) AS h")
    moved = hull.select(feed.pushed_out(F.col("h"), math.sqrt(2.0)).alias("h")).first().h
    assert [(round(p.x, 9), round(p.y, 9)) for p in moved] == [(-1, -1), (3, -1), (3, 3), (-1, 3)]


def test_strata_and_model(spark):
    strata = spark.createDataFrame([("spruce", 40, 20.0, 12.0), ("larch", 10, 30.0, 8.0)], "species string, n_stems int, mean_dbh_cm double, total_volume_m3 double")
    made = harvest.stems_from_strata(strata, 3).cache()
    assert {r.species: round(r.v, 9) for r in made.groupBy("species").agg(F.sum("stem_volume_m3").alias("v")).collect()} == {"spruce": 12.0, "larch": 8.0}
    timed = harvest.predicted_cycles(made, lambda pdf: pdf["dbh_cm"].fillna(0) * 0.1 + pdf["slope_deg"].isna(), ["dbh_cm", "slope_deg"])
    assert all(abs(r.log_cycle - (r.dbh_cm * 0.1 + 1)) < 1e-9 for r in timed.collect())


def test_tiers_and_crowns(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.9, 0.1, 50), (2, 0.1, 0.9, 0.1, 50), (3, 0.1, 0.1, 0.9, 50), (4, 0.9, 0.9, 0.1, 0)], "tree_id int, linearity double, verticality double, drift_mean double, n_points int")
    assert [r.segment_qc_tier for r in segments.segment_tiers(rows).orderBy("tree_id").collect()] == ["high", "medium", "reject", "reject"]
    crowns = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (1, 0, 8)], "row int, col int, label long")
    assert {r.label: r.area_m2 for r in segments.crown_summary(crowns, 2.0).collect()} == {7: 8.0, 8: 4.0}


def test_models_and_confidence(spark):
    slices = spark.createDataFrame([(1, z / 2, 0.2 - 0.005 * z, 1 + 0.01 * z, 2.0, 150.0, 0.01, 0.8, 1.0, 1.0) for z in range(1, 9)], "tree_id int, z_mid double, radius_m double, cx double, cy double, coverage_deg double, residual_m double, slice_score double, weight_radius double, weight_centre double")
    models = stems.taper_models(slices, ["tree_id"])
    m = models.first()
    assert math.isclose(m.r_coef_1, -0.007, rel_tol=1e-6) and math.isclose(m.cx_coef_1, 0.02, rel_tol=1e-6)
    errors = stems.model_rmse(slices, models, ["tree_id"]).first()
    assert errors.centre_rmse < 1e-9 and errors.radius_rmse < 0.005
    rows = stems.profile(models, slices, ["tree_id"]).withColumns({"coverage_near": F.lit(150.0), "residual_near": F.lit(0.01), "score_near": F.lit(0.8), "centre_rmse": F.lit(0.0), "radius_rmse": F.lit(0.0)})
    found = stems.profile_confidence(rows).collect()
    assert len(found) == 23 and all(0 < r.profile_confidence < 1 for r in found) and {r.diameter_source for r in found} <= {"direct", "interpolated", "model_only"}


def test_top_clusters_and_tiles(spark):
    found = spark.createDataFrame([(100, 3, 0.0, 0.0), (40, 2, 9.0, 9.0), (5, 1, 20.0, 3.0)], "n_points long, n_cells long, x_min double, y_min double")
    assert [(r["rank"], r.suspicious) for r in grid.top_clusters(found, 2).collect()] == [(1, False), (2, True)]
    assert grid.tile_size(0, 1.0) == 500.0 and grid.tile_size(10**9, 10**6) == math.sqrt(12_000)


def test_sessions(spark):
    rows = spark.sql("SELECT 'm' machine, explode(array(timestamp'2024-01-01 10:00:00', timestamp'2024-01-01 10:20:00', timestamp'2024-01-01 12:00:00')) file_time, 2L volume_cm3")
    assert sorted((r.n_files, r.volume) for r in feed_stream.session_activity(rows).collect()) == [(1, 2), (2, 4)]


def test_repeated_epoch_changes_nothing(spark):
    files = spark.sql("SELECT 'f1' file_name, 1L object_id, timestamp'2024-01-01 10:00:00' file_time, 5L volume_cm3, 'm' machine")
    sink = feed_stream.RollupSink(spark, ["object_id"])
    for epoch in (0, 1, 1):
        sink(files.withColumn("file_name", F.lit(f"f{epoch}")), epoch)
    (row,) = sink.table(spark, "").collect()
    assert (row.n_files, row.volume) == (2, 10)


def test_a_file_counts_once_over_epochs_restarts_and_late(spark, tmp_path):
    def batch(*names):
        rows = [(n, 1, f"2024-01-0{1 + len(n) % 3} 10:00:00", 5, "m") for n in names]
        return spark.createDataFrame(rows, "file_name string, object_id long, file_time string, volume_cm3 long, machine string").withColumn("file_time", F.col("file_time").cast("timestamp"))

    folder = f"file://{tmp_path}/roll"
    for epoch, names in enumerate((["aaa", "b", "b"], ["aaa", "cc"], ["d"], ["b"])):
        feed_stream.RollupSink(spark, ["object_id"], folder)(batch(*names), epoch)  # a new sink, as after a restart
    feed_stream.RollupSink(spark, ["object_id"], folder)(batch("b"), 3)
    (row,) = feed_stream.RollupSink(spark, ["object_id"], folder).table(spark, "").collect()
    assert (row.n_files, row.volume) == (4, 20)


def test_stream_in_several_epochs_equals_the_batch(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "file_name string, object_id long, file_time timestamp, volume_cm3 long, machine string"
    for part, names in enumerate((["x1", "x2"], ["x2", "x3"], ["x1", "x4"])):
        rows = spark.createDataFrame([(n, int(n[1]) % 2, n) for n in names], "file_name string, object_id long, machine string")
        late = rows.withColumns({"file_time": F.lit(f"2024-01-{10 - part:02d} 00:00:00").cast("timestamp"), "volume_cm3": F.lit(2).cast("long")})
        late.select("file_name", "object_id", "file_time", "volume_cm3", "machine").write.mode("append").parquet(str(source))
        got = feed_stream.rolled_up_stream(spark.readStream.schema(schema).parquet(str(source)), ["object_id"], folder)
    assert {(r.object_id, r.n_files, r.volume) for r in got.collect()} == {(0, 2, 4), (1, 2, 4)}


def test_containment_is_the_same_for_any_number_of_sites(spark):
    objects = spark.createDataFrame([(1, "Greatoakwood 7"), (2, "Oakwood"), (3, "the oakwo"), (4, None), (5, "Elm")], "object_id long, name string")
    sites = [(1, 1, "Oakwood", "c1"), (2, 2, "Greatoak", "c2"), (3, 3, "Elm", None), (4, 4, None, "")] + [(i, i, f"Filler {i} oakw", None) for i in range(5, 300)]
    got = spatial.name_cascade(objects, spark.createDataFrame(sites, "site_id long, ordinal long, name string, code string"), S.match_key)
    assert {r.object_id: (r.site_id, r.matched_by) for r in got.collect()} == {1: (1, "contains"), 2: (1, "name"), 3: (None, "none"), 4: (None, "none"), 5: (3, "name")}


def test_linearity_leaves_the_point_out(spark):
    rng = np.random.default_rng(12)
    xyz, k = rng.normal(0, 1, (60, 3)), 20
    points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)] + [(2, 100 + i, float(i), 0.0, 0.0) for i in range(k)], "tree_id long, point_id long, x double, y double, z double")
    got = {r.point_id: r.linearity for r in segments.linearity(points, "tree_id").collect()}
    assert {got[100 + i] for i in range(k)} == {0.5}
    for i in range(60):
        others = xyz[np.argsort(((xyz - xyz[i]) ** 2).sum(1))[1 : k + 1]]
        values = np.linalg.eigvalsh(np.cov(others.T))
        assert abs(got[i] - (values[2] - values[1]) / (values[2] + 1e-9)) < 1e-9
    none = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(30)], "tree_id long, point_id long, x double, y double, z double")
    assert {r.linearity for r in segments.linearity(none, "tree_id").collect()} == {0.0}


def test_circle_tolerance_is_the_deviation_from_the_median():
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 80)
    ring = 0.1 + np.where(np.arange(80) % 2, 0.012, -0.012) + rng.normal(0, 0.004, 80)
    x, y = ring * np.cos(angle), ring * np.sin(angle)
    start = np.median(x), np.median(y), np.median(np.hypot(x - np.median(x), y - np.median(y)))
    cx, cy, r = circles._refined(x, y, start)
    error = np.abs(np.hypot(x - cx, y - cy) - r)
    limit = np.clip(1.4826 * np.median(np.abs(error - np.median(error))) * 2.5, 0.010, 0.050)
    want = int((error <= limit).sum())
    assert 6 <= want < 80 and circles.robust_circle(x, y, rounds=1)[4] == want


def test_suppression_of_a_long_chain(spark):
    tops = spark.createDataFrame([(i, float(i), 0.0, 100.0 - i) for i in range(14)], "tree_id long, x double, y double, height_m double")
    assert sorted(r.tree_id for r in segments.suppressed(tops, 1.5).collect()) == list(range(0, 14, 2))


def test_nearest_of_a_far_row(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 5e7, 0.0), (3, None, 1.0)], "point_id long, x double, y double")
    right = spark.createDataFrame([(7, 1.0, 0.0)], "ground_id long, x double, y double")
    assert {(r.point_id, r.ground_id) for r in spatial.nearest(left, right).collect()} == {(1, 7), (2, 7)}

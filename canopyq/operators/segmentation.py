"""The whole tree segmentation: canopy model, tops, crowns, stem points, scores, and the filters after them, as one chain of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.operators import circles, grid, segments, spatial, stats, stems
from canopyq.operators.neighbours import linearity
from canopyq.plans.storage import stored

KEY = "tree_id"
#: Points that lie in one place, as a row of a stored cloud.
COPIES = "copies"


@dataclass(frozen=True)
class SegmentRules:
    """Cells and tops in metres, the band of stem heights, least points of a tree, the density filter, the radial filter and the linearity of single points."""

    size: float = 0.3
    half: int = 1
    apart: float = 0.3
    least: float = 10.0
    low: float = 0.5
    high: float = 5.0
    least_points: int = 20
    density_radius: float = 0.12
    density_least: int = 3
    radius: float = 0.9
    radius_least: int = 10
    linearity: float = 0.40
    neighbours: int = 20


def tree_tops(points: DataFrame, smooth: DataFrame, rules: SegmentRules, x0: float, y0: float) -> DataFrame:
    """Tops (tree_id, row, col, x, y, height_m): maxima of the smoothed canopy that no higher one is near to, with the highest point around each; numbered by row and column."""
    peaks = grid.local_maxima(smooth, rules.half, rules.least)
    placed = peaks.select((F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("place"), "row", "col", (F.col("col") * rules.size + x0).alias("x"), (F.col("row") * rules.size + y0).alias("y"), F.col("value").cast("double").alias("height_m"))
    left = segments.suppressed(placed, rules.apart, "place")
    refined = spatial.radius_max(left, points.select("x", "y", "z"), rules.size, "place", "height_m").withColumn("height_m", F.col("top_z")).drop("place", "top_z")
    return stats.numbered(refined.withColumn("_block", F.floor(F.col("row") / 1024)), ["_block"], ["row", "col"], KEY).drop("_block")


def segment_trees(points: DataFrame, rules: SegmentRules = SegmentRules()) -> dict[str, DataFrame]:
    """Tables of a segmentation of points (x, y, z above ground).

    ``treetops``; ``crowns`` (row, col, label); ``segment_points`` (tree_id, x, y, z, stem_score), the points that are left; ``segment_summary``, a row for every top. In order:
    canopy model with its origin at the lowest x and y, smoothed; tops; crowns by watershed over the four sides of cells; points of the stem band by crown, small trees cleared; points
    with few others around dropped, small trees cleared again; scores; points far from the tree's top, or its seed where the top has no place, dropped, unless too few would stay;
    points whose surroundings aren't line-like dropped. Trees without points after the density filter aren't scored. Points without coordinates are left out; without points all tables are empty.
    Points of one place are one row with their number until the end, so a cloud of copies costs no more than its places.
    """
    named = points.where("x is not null and y is not null and z is not null").select(F.monotonically_increasing_id().alias("point_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    cloud = stored(named.groupBy("x", "y", "z").agg(F.min("point_id").alias("point_id"), F.count("*").alias(COPIES)), "cloud")
    ends = cloud.agg(F.min("x"), F.min("y")).first()
    x0, y0 = ends[0] or 0.0, ends[1] or 0.0
    cells = grid.celled(cloud, rules.size, x0, y0)
    canopy = cells.groupBy("row", "col").agg(F.greatest(F.max(F.col("z").cast("float")), F.lit(0).cast("float")).alias("value"))
    smooth = stored(segments.smoothed(canopy, everywhere=True, single=True).where(F.col("value") > 0), "canopy")
    tops = stored(tree_tops(cloud, smooth, rules, x0, y0), "tops")
    crowns = stored(segments.watershed(smooth, tops.select("row", "col", F.col(KEY).alias("label")), least=rules.least, diagonals=False), "crowns")

    band = cells.where(F.col("z").between(rules.low, rules.high)).join(crowns.withColumnRenamed("label", KEY), ["row", "col"], "left")
    raw = segments.dense_enough(band.select("point_id", "x", "y", "z", COPIES, F.coalesce(KEY, F.lit(0)).cast("long").alias(KEY)), KEY, rules.least_points, COPIES)
    raw = stored(raw, "band")
    crowded = spatial.crowded(raw, rules.density_radius, rules.density_least, COPIES)
    dense = stored(segments.dense_enough(crowded, KEY, rules.least_points, COPIES).where(F.col(KEY) > 0), "dense")

    axes = stored(segments.principal_axes(dense, KEY, COPIES).withColumnRenamed("n", "n_points"), "axes")
    scores = segments.segment_scores(axes.join(stems.centroid_drift(dense, [KEY], from_lowest=True, copies=COPIES), KEY, "left"))
    seeds = circles.seeds(axes, circles.seed_fits(dense, copies=COPIES)).drop("n_points")
    scored = stored(scores.join(seeds, KEY, "left"), "scores")
    accepted = dense.join(scored.where("segment_status <> 'rejected_after_scoring'").select(KEY, "seed_cx", "seed_cy"), KEY)
    centres = tops.select(KEY, "x", "y").join(scored.select(KEY, "seed_cx", "seed_cy"), KEY)
    centres = centres.select(KEY, F.coalesce("x", "seed_cx").alias("x"), F.coalesce("y", "seed_cy").alias("y"))
    judged = stored(segments.radial_filter(accepted.drop("seed_cx", "seed_cy"), centres, KEY, rules.radius, rules.radius_least, COPIES), "radial")
    near = judged.where("kept").drop("kept", "retention")
    line = linearity(near, KEY, "point_id", rules.neighbours, copies=COPIES)
    final = stored(near.join(line.select("point_id", F.col("linearity").alias("stem_score")), "point_id").where(F.col("stem_score") >= rules.linearity), "final")

    count = lambda df, name: df.where(F.col(KEY) > 0).groupBy(KEY).agg(F.sum(COPIES).alias(name))
    radial = judged.groupBy(KEY).agg(F.sum(COPIES).alias("radial_n_before"), F.sum(F.when(~F.col("kept"), F.col(COPIES)).otherwise(0)).alias("radial_n_removed"), F.round(F.first("retention"), 4).alias("radial_retention_frac"))
    crown = segments.crown_summary(crowns, rules.size).select(F.col("label").alias(KEY), F.col("area_m2").alias("crown_area_m2"), F.col("diameter_m").alias("crown_diam_m"), F.col("n_cells").alias("crown_n_pixels"))
    summary = tops.select(KEY, F.col("x").alias("tree_top_x"), F.col("y").alias("tree_top_y"), F.col("height_m").alias("canopy_height_m"))
    for table in (count(raw, "n_points_raw"), count(dense, "n_points_after_density"), count(final, "n_points_final"), radial, scored.drop("n_points"), crown):
        summary = summary.join(table, KEY, "left")
    return {"treetops": tops, "crowns": crowns, "segment_points": _each_copy(final).select(KEY, "x", "y", "z", "stem_score"), "segment_summary": _filled(summary)}


def _each_copy(places: DataFrame, part: int = 4096) -> DataFrame:
    """A row for each point of a place; parts of at most ``part`` points are told apart first, so no array is long."""
    parts = places.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(COPIES) - 1) / part))))
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(part), F.col(COPIES) - F.col("_part") * part)))).drop("_part", "_copy")


def _filled(summary: DataFrame) -> DataFrame:
    """Counts that are missing as 0, and what a tree that was never scored says of itself."""
    zero = ("n_points_raw", "n_points_after_density", "n_points_final", "radial_n_before", "radial_n_removed", "seed_n_slices", "n_slices", "crown_n_pixels")
    text: dict[str, Column] = {c: F.coalesce(c, F.lit(v)) for c, v in (("seed_status", "not_scored"), ("fail_reasons", ""), ("segment_status", "rejected_before_scoring"), ("segment_qc_tier", "failed"))}
    names = {"linearity": "pca_linearity", "verticality": "pca_verticality", "n_slices": "n_centroid_slices", "drift_mean": "mean_centroid_drift_m", "drift_max": "max_centroid_drift_m"}
    return summary.fillna(0, zero).withColumns(text).withColumnsRenamed(names)

"""Registered queries of point clouds: LAS files, neighbours, covers, drainage and segmentation, and oracles of queries registered elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq.operators import neighbours, segmentation, segments, spatial, stems
from canopyq.plans.catalog import _CELLS, ORACLES, registered, rounded
from canopyq.plans.recipes import oracle_recipe, polygons, recipe
from canopyq.plans.storage import shared_folder
from canopyq.sources import las


@registered("SELECT CAST(grp AS INT) AS classification, count(*) AS n, round(sum(z), 2) AS z_sum, min(x) AS x_min, max(y) AS y_max FROM {spots} WHERE x > 200e0 AND x <= 600.5e0 AND y < 500e0 GROUP BY 1")
def las_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as LAS files and read again within bounds."""
    path = f"{shared_folder(spark).rstrip('/')}/las-{uuid.uuid4().hex}"
    points = recipe(spark, sf_dir, "spots").withColumn("classification", F.col("grp"))
    las.write_las(points.repartitionByRange(4, "x"), path, file_points=2000)
    found = las.read_las(spark, path, part_bytes=20_000).where("x > 200 and x <= 600.5 and y < 500")
    return rounded(found.groupBy("classification").agg(F.count("*").alias("n"), F.sum("z").alias("z_sum"), F.min("x").alias("x_min"), F.max("y").alias("y_max")), "z_sum", digits=2)


@registered("SELECT count(*) AS n_points, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {spots}")
def las_header_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of LAS files, without a point read: together the number and the bounds of all points."""
    path = f"{shared_folder(spark).rstrip('/')}/las-{uuid.uuid4().hex}"
    las.write_las(recipe(spark, sf_dir, "spots").select("x", "y", "z"), path, file_points=500)
    return las.las_headers(spark, path).agg(F.sum("point_count").alias("n_points"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


@registered("""
SELECT point_id, CAST(k AS INT) AS rank, ground_id, distance FROM (SELECT p.point_id, g.ground_id, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS distance,
row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y), g.ground_id) AS k FROM {spots} p CROSS JOIN {ground} g) WHERE k <= 4""")
def k_nearest_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.k_nearest(recipe(spark, sf_dir, "spots"), recipe(spark, sf_dir, "ground"), 4)
    each = found.select("point_id", F.posexplode(F.arrays_zip("keys", "distances")).alias("at", "n"))
    return each.select("point_id", (F.col("at") + 1).alias("rank"), F.col("n.keys").alias("ground_id"), F.col("n.distances").alias("distance"))


@registered("SELECT p.point_id, count(g.ground_id) AS n FROM {spots} p LEFT JOIN {ground} g ON (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y) <= 10000e0 GROUP BY 1")
def ground_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    ground = recipe(spark, sf_dir, "ground").select("ground_id", "x", "y")
    return neighbours.count_within(recipe(spark, sf_dir, "spots"), ground, 100.0)


@registered("""
WITH p AS (SELECT * FROM {spots}), e AS {edges}
SELECT p.point_id, e.poly_id FROM p JOIN e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1""")
def polygons_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polygon that holds each point, from small cells."""
    return spatial.inside(recipe(spark, sf_dir, "spots"), spatial.ring_edges(polygons(spark)), 15.0).select("point_id", "poly_id")


@registered("""
WITH l AS (SELECT CAST(l_suppkey AS BIGINT) AS tree_id, l_quantity AS z, l_discount AS x, l_tax AS y, min(l_quantity) OVER (PARTITION BY l_suppkey) AS z0, max(l_quantity) OVER (PARTITION BY l_suppkey) AS z1 FROM lineitem),
s AS (SELECT tree_id, floor((z - z0) / 8e0) AS s, count(*) AS n, avg(x) AS x, avg(y) AS y FROM l WHERE floor((z - z0) / 8e0) * 8e0 + z0 < z1 GROUP BY 1, 2 HAVING count(*) >= 5),
d AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM s WINDOW w AS (PARTITION BY tree_id ORDER BY s))
SELECT tree_id, count(*) AS n_slices, round(avg(d), 6) AS drift_mean, round(max(d), 6) AS drift_max FROM d GROUP BY 1""")
def centroid_drift_from_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("tree_id"), F.col("l_quantity").alias("z"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    return rounded(stems.centroid_drift(points, ["tree_id"], 8.0, from_lowest=True), "drift_mean", "drift_max")


_SCORED = ORACLES["segment_scores"]


@registered(
    _SCORED.replace("CAST(few AS INT) + CAST(bent AS INT) AS failures", "CASE WHEN n_points = 0 THEN 3 ELSE CAST(few AS INT) + CAST(bent AS INT) END AS failures")
    .replace("concat_ws(';', CASE WHEN few", "CASE WHEN n_points = 0 THEN 'empty_after_density_filter' ELSE concat_ws(';', CASE WHEN few").replace("drift_mean) END) AS fail_reasons", "drift_mean) END) END AS fail_reasons")
    .replace("CASE WHEN few OR bent THEN 'accepted", "CASE WHEN n_points = 0 THEN 'rejected_after_scoring' WHEN few OR bent THEN 'accepted").replace("CASE WHEN few OR bent THEN 'moderate'", "CASE WHEN n_points = 0 THEN 'failed' WHEN few OR bent THEN 'moderate'")
)
def segment_scores_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in which segments without points are rejected."""
    each = recipe(spark, sf_dir, "slices").groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_slices"), F.round(F.max("cx") * 10, 2).alias("linearity"), F.round(F.max("cy") * 10, 2).alias("verticality"), (F.max("n_points") * 5).alias("n_points"),
        F.round(F.min("cx") * 6, 2).alias("drift_mean"), (F.max("cx") * 8).alias("drift_max"),
    )
    return segments.segment_scores(each).select("tree_id", "failures", "fail_reasons", "segment_status", "segment_qc_tier")


@registered()
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole segmentation with limits as wide as the projected cloud is thin."""
    rules = segmentation.SegmentRules(size=10.0, least=0.5, apart=15.0, low=0.5, high=15.0, least_points=5, density_radius=8.0, density_least=1, radius=20.0, radius_least=3, linearity=0.2, neighbours=4)
    return segmentation.segment_trees(recipe(spark, sf_dir, "points"), rules)["segment_summary"]


#: Eigenvalues of a symmetric 3 x 3 matrix by the trigonometric solution of its cubic, and the first vector as the longest product of two rows of A - l1 I.
ORACLES["segment_axes"] = f"""
WITH c AS (SELECT grp AS tree_id, count(*) AS n, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM {oracle_recipe("spots")} GROUP BY 1),
q AS (SELECT *, (a + b + c) / 3e0 AS q FROM c),
p AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2e0 * (d * d + e * e + f * f)) / 6e0) AS p FROM q),
r AS (SELECT *, greatest(-1e0, least(1e0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2e0 * p * p * p))) AS r FROM p),
v AS (SELECT *, q + 2e0 * p * cos(acos(r) / 3e0) AS l1, q + 2e0 * p * cos(acos(r) / 3e0 + 2e0 * pi() / 3e0) AS l3 FROM r),
w AS (SELECT *, 3e0 * q - l1 - l3 AS l2, [[d * f - e * (b - l1), e * d - (a - l1) * f, (a - l1) * (b - l1) - d * d], [d * (c - l1) - e * f, e * e - (a - l1) * (c - l1), (a - l1) * f - d * e], [(b - l1) * (c - l1) - f * f, f * e - d * (c - l1), d * f - (b - l1) * e]] AS vs FROM v),
z AS (SELECT *, list_transform(vs, lambda v: v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS ns FROM w)
SELECT tree_id, n, round((l1 - l2) / (l1 + 1e-9 * 3e0 * q), 6) AS linearity, round(abs(vs[list_position(ns, list_max(ns))][3]) / sqrt(list_max(ns)), 6) AS verticality FROM z
"""

ORACLES["gaussian_smooth"] = f"""
{_CELLS.replace("{points}", oracle_recipe("points"))}, e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g),
k AS (SELECT k, exp(-0.5e0 * k * k) / sum(exp(-0.5e0 * k * k)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
p AS (SELECT t.row, t.c AS col, k.k, k.w, ((t.row - r0 + k.k) % (2 * (r1 - r0 + 1)) + 2 * (r1 - r0 + 1)) % (2 * (r1 - r0 + 1)) AS q, r1 - r0 + 1 AS n, r0 FROM (SELECT DISTINCT a.row, b.col AS c FROM g a CROSS JOIN (SELECT DISTINCT col FROM g) b) t CROSS JOIN e CROSS JOIN k),
o AS (SELECT p.row, p.col, sum(p.w * coalesce(g.value, 0)) AS value FROM p LEFT JOIN g ON g.col = p.col AND g.row = (CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END) + r0 GROUP BY 1, 2),
s AS (SELECT g.row, g.col, k.w, ((g.col - c0 + k.k) % (2 * (c1 - c0 + 1)) + 2 * (c1 - c0 + 1)) % (2 * (c1 - c0 + 1)) AS q, c1 - c0 + 1 AS n, c0 FROM g CROSS JOIN e CROSS JOIN k)
SELECT s.row, s.col, round(sum(s.w * coalesce(o.value, 0)), 6) AS value FROM s LEFT JOIN o ON o.row = s.row AND o.col = (CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END) + c0 GROUP BY 1, 2
"""

"""Registered queries of the forest and terrain operators, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.functions import scalar as S
from canopyq.operators import circles, feed, grid, harvest, segments, spatial, stats, stems, tariff, terrain
from canopyq.plans.recipes import RECIPES, oracle_edges, oracle_recipe, polygons, recipe
from canopyq.streaming import feed_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``{name}`` in the SQL stands for a projection."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if oracle is not None:
            text = oracle.replace("{edges}", oracle_edges())
            for name in ("points", "spots", "ground", "trees", "slices", "files", "stems"):
                text = text.replace(f"{{{name}}}", oracle_recipe(name))
            ORACLES[query.__name__] = text
        return query

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles whose last bits depend on the order of summing, rounded for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff_compartment(spark, sf_dir)


# --- gridding


@registered("SELECT CAST(floor(y / 5e0) AS INT) AS row, CAST(floor(x / 5e0) AS INT) AS col, max(CAST(z AS FLOAT)) AS value FROM {points} GROUP BY 1, 2 HAVING max(CAST(z AS FLOAT)) > 0")
def chm_cell_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.canopy_height(recipe(spark, sf_dir, "points"), 5.0)


@registered("SELECT CAST(floor(y / 1e1) AS INT) AS row, CAST(floor(x / 1e1) AS INT) AS col, median(x) AS x, median(y) AS y, median(z) AS ground_z FROM {points} GROUP BY 1, 2")
def ground_cell_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.ground_median(recipe(spark, sf_dir, "points"), 10.0)


@registered("SELECT CAST(floor(y / 2e0) AS INT) AS row, CAST(floor(x / 2e0) AS INT) AS col, min(z) AS z_min, max(z) AS z_max, count(*) AS n, min(CASE WHEN classification = 2 THEN z END) AS ground_min FROM {points} GROUP BY 1, 2")
def cell_minmaxcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_profile(recipe(spark, sf_dir, "points"), 2.0, F.col("classification") == 2)


_HEX = """
WITH c AS (SELECT (x * (sqrt(3e0) / 3e0) - y / 3e0) / {R} AS q, (y * (2e0 / 3e0)) / {R} AS r FROM {points}),
k AS (SELECT q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM c),
d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM k),
h AS (SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS hex_q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS hex_r FROM d),
n AS (SELECT hex_q, hex_r, count(*) AS n FROM h GROUP BY 1, 2)
SELECT hex_q, hex_r, n, n / (4e2 / 1e4) AS per_ha, n / CAST(max(n) OVER () AS DOUBLE) AS share FROM n
""".replace("{R}", repr(S.hex_radius(400.0)))


@registered(_HEX)
def hex_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.hex_density(recipe(spark, sf_dir, "points"), 400.0)


@registered("""
WITH RECURSIVE c AS (SELECT CAST(floor(y / 1e1) AS INT) AS r, CAST(floor(x / 1e1) AS INT) AS c, count(*) AS n FROM {points} WHERE z > 15 GROUP BY 1, 2 HAVING count(*) >= 2),
w(r, c, root) AS (SELECT r, c, r * 100000 + c FROM c UNION SELECT b.r, b.c, w.root FROM w JOIN c b ON abs(b.r - w.r) <= 1 AND abs(b.c - w.c) <= 1),
m AS (SELECT r, c, min(root) AS root FROM w GROUP BY 1, 2)
SELECT CAST(sum(c.n) AS BIGINT) AS n_points, count(*) AS n_cells, min(c.c) * 1e1 AS x_min, min(c.r) * 1e1 AS y_min, (max(c.c) + 1) * 1e1 AS x_max, (max(c.r) + 1) * 1e1 AS y_max
FROM m JOIN c USING (r, c) GROUP BY root""")
def crop_dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.clusters(recipe(spark, sf_dir, "points").where("z > 15"), 10.0, 0.02)


@registered("""
WITH c AS (SELECT CAST(floor(y / 2e2) AS INT) AS r, CAST(floor(x / 2e2) AS INT) AS c, count(*) AS n FROM {points} GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY n DESC, r, c) AS INT) AS rank, r AS row, c AS col, n, coalesce(n > 0.25e0 * lag(n) OVER (ORDER BY n DESC, r, c), false) AS near_before FROM c ORDER BY n DESC, r, c LIMIT 6""")
def topk_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.celled(recipe(spark, sf_dir, "points"), 200.0).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    top = cells.orderBy(F.desc("n"), "row", "col").limit(6)
    order = Window.orderBy(F.desc("n"), "row", "col")  # six rows
    return top.select(F.row_number().over(order).alias("rank"), "row", "col", "n", F.coalesce(F.col("n") > F.lag("n").over(order) * 0.25, F.lit(False)).alias("near_before"))


_CELLS = "WITH g AS (SELECT CAST(floor(y / 2e1) AS INT) AS row, CAST(floor(x / 2e1) AS INT) AS col, max(z) AS value FROM {points} GROUP BY 1, 2)"
_NEAR = _CELLS + ", n AS (SELECT g.row, g.col, g.value, h.value AS near, h.row - g.row AS a, h.col - g.col AS b FROM g JOIN g h ON abs(h.row - g.row) <= 1 AND abs(h.col - g.col) <= 1)"


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.celled(recipe(spark, sf_dir, "points"), 20.0).groupBy("row", "col").agg(F.max("z").alias("value"))


@registered(_NEAR + " SELECT row, col, any_value(value) AS value FROM n GROUP BY 1, 2 HAVING any_value(value) = max(near)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.local_maxima(_surface(spark, sf_dir), 1)


@registered(_NEAR + " SELECT row, col, any_value(value) AS value, median(near) AS focal FROM n GROUP BY 1, 2")
def focal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.focal(_surface(spark, sf_dir), 1, focal=F.median("near"))


@registered(_NEAR + " SELECT row, col, round(any_value(value) - avg(near), 6) AS tpi, round(stddev_pop(near), 6) AS roughness FROM n GROUP BY 1, 2")
def focal_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.focal(_surface(spark, sf_dir), 1, roughness=F.stddev_pop("near"), mean=F.avg("near"))
    return rounded(found.select("row", "col", (F.col("value") - F.col("mean")).alias("tpi"), "roughness"), "tpi", "roughness")


_HORN = _NEAR + """, s AS (SELECT row, col, sum(b * (2 - abs(a)) * CASE WHEN b <> 0 THEN near ELSE 0e0 END) / 160e0 AS gx, sum(a * (2 - abs(b)) * CASE WHEN a <> 0 THEN near ELSE 0e0 END) / 160e0 AS gy FROM n GROUP BY 1, 2 HAVING count(*) = 9)"""


@registered(_HORN + " SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(gx, 6) AS gx, round(gy, 6) AS gy FROM s")
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(grid.slope_aspect(_surface(spark, sf_dir), 20.0).select("row", "col", "slope", "gx", "gy"), "slope", digits=5), "gx", "gy")


@registered(_HORN + ", t AS (SELECT degrees(atan(sqrt(gx * gx + gy * gy))) AS v FROM s) SELECT count(v) AS n_cells, round(min(v), 5) AS v_min, round(max(v), 5) AS v_max, round(avg(v), 5) AS v_mean, round(avg(CASE WHEN v > 30 THEN 100e0 ELSE 0e0 END), 5) AS percent_above FROM t")
def slope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.raster_summary(grid.slope_aspect(_surface(spark, sf_dir), 20.0), "slope"), "v_min", "v_max", "v_mean", "percent_above", digits=5)


@registered(_HORN + ", l AS (SELECT row, col, atan(sqrt(gx * gx + gy * gy)) AS sl, atan2(-gx, -gy) AS az FROM s) SELECT row, col, round(255e0 * greatest(0e0, least(1e0, cos(radians(45e0)) * cos(sl) + sin(radians(45e0)) * sin(sl) * cos(radians(315e0) - az))), 4) AS shade FROM l")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.hillshade(grid.slope_aspect(_surface(spark, sf_dir), 20.0)), "shade", digits=4)


@registered(_NEAR + """, p AS (SELECT *, CASE WHEN a = -1 THEN b + 1 WHEN a = 0 THEN CASE WHEN b = -1 THEN 3 ELSE 4 END ELSE b + 6 END AS k, (value - near) / CASE WHEN abs(a) + abs(b) = 2 THEN 20e0 * pow(2e0, 0.5e0) ELSE 20e0 END AS d FROM n WHERE abs(a) + abs(b) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d DESC, k) AS o FROM p WHERE d > 0)
SELECT g.row, g.col, CAST(t.k AS INT) AS direction, CAST(t.row + t.a AS INT) AS to_row, CAST(t.col + t.b AS INT) AS to_col FROM g LEFT JOIN t ON t.row = g.row AND t.col = g.col AND t.o = 1""")
def d8_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.d8(_surface(spark, sf_dir), 20.0)


@registered(_CELLS + """, p AS (SELECT point_id, x, y, CAST(floor(x / 20e0 - 0.5e0) AS INT) AS c, CAST(floor(y / 20e0 - 0.5e0) AS INT) AS r FROM {spots}),
q AS (SELECT p.*, x / 20e0 - 0.5e0 - c AS u, y / 20e0 - 0.5e0 - r AS v FROM p),
f AS (SELECT point_id, g.value, g.row, g.col, CASE WHEN g.col = q.c THEN 1 - u ELSE u END AS wu, CASE WHEN g.row = q.r THEN 1 - v ELSE v END AS wv FROM q JOIN g ON g.row BETWEEN q.r AND q.r + 1 AND g.col BETWEEN q.c AND q.c + 1),
s AS (SELECT point_id, count(*) AS n, sum(value * wu * wv) AS b FROM f GROUP BY 1),
t AS (SELECT point_id, value, row_number() OVER (PARTITION BY point_id ORDER BY pow(1 - wu, 2) + pow(1 - wv, 2), row, col) AS o FROM f)
SELECT p.point_id, round(CASE WHEN s.n = 4 THEN s.b ELSE t.value END, 9) AS sample FROM p LEFT JOIN s USING (point_id) LEFT JOIN t ON t.point_id = p.point_id AND t.o = 1""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.bilinear(recipe(spark, sf_dir, "spots"), _surface(spark, sf_dir), 20.0).select("point_id", "sample"), "sample", digits=9)


@registered("""
WITH p AS (SELECT * FROM {spots}), i AS (SELECT p.*, unnest(generate_series(CAST(floor((x - 1e1) / 1e2) AS BIGINT), CAST(floor((x + 1e1) / 1e2) AS BIGINT))) AS tile_i FROM p),
j AS (SELECT i.*, unnest(generate_series(CAST(floor((y - 1e1) / 1e2) AS BIGINT), CAST(floor((y + 1e1) / 1e2) AS BIGINT))) AS tile_j FROM i)
SELECT tile_i, tile_j, count(*) AS n_points, count(*) FILTER (WHERE tile_i = floor(x / 1e2) AND tile_j = floor(y / 1e2)) AS n_core FROM j GROUP BY 1, 2""")
def tiles_with_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_rows(recipe(spark, sf_dir, "spots"), 100.0, 10.0).groupBy("tile_i", "tile_j").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("is_core").alias("n_core"))


# --- spatial joins


@registered("""
SELECT point_id, ground_id, distance FROM (SELECT p.point_id, g.ground_id, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS distance,
row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y), g.ground_id) AS k FROM {spots} p CROSS JOIN {ground} g) WHERE k = 1""")
def nearest_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(recipe(spark, sf_dir, "spots"), recipe(spark, sf_dir, "ground"))


@registered("""
SELECT a.point_id, count(b.point_id) AS n_near FROM {spots} a LEFT JOIN {spots} b ON a.point_id <> b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225e0 GROUP BY 1""")
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_count(recipe(spark, sf_dir, "spots").select("point_id", "x", "y"), 15.0).select("point_id", "n_near")


@registered("SELECT g.ground_id, coalesce(max(p.z), -1e0) AS top_z FROM {ground} g LEFT JOIN {points} p ON (g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y) <= 16e0 GROUP BY 1")
def radius_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = recipe(spark, sf_dir, "ground").withColumn("own", F.lit(-1.0))
    return spatial.radius_max(seeds, recipe(spark, sf_dir, "points").select("x", "y", "z"), 4.0, "ground_id", "own").select("ground_id", "top_z")


_PIP = """
WITH p AS (SELECT * FROM {spots}), e AS {edges},
h AS (SELECT p.point_id, e.poly_id, e.ordinal FROM p JOIN e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1)
"""


@registered(_PIP + "SELECT p.point_id, min_by(h.poly_id, h.ordinal) AS poly_id FROM p LEFT JOIN h USING (point_id) GROUP BY 1")
def pip_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.first_polygon(recipe(spark, sf_dir, "spots").select("point_id", "x", "y"), spatial.ring_edges(polygons(spark)), 50.0).select("point_id", "poly_id")


@registered(_PIP + """, t AS (SELECT grp, count(*) AS n_located FROM p GROUP BY 1), c AS (SELECT grp, poly_id, ordinal, count(*) AS k, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, ordinal) AS o FROM h JOIN p USING (point_id) GROUP BY 1, 2, 3)
SELECT t.grp, n_located, coalesce(c.k, 0) AS n_hits, CASE WHEN n_located >= 3 AND c.k >= greatest(3, n_located * 0.3e0) THEN poly_id END AS poly_id FROM t LEFT JOIN c ON c.grp = t.grp AND c.o = 1""")
def site_majority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.majority_polygon(recipe(spark, sf_dir, "spots"), spatial.ring_edges(polygons(spark)), 50.0, "grp", share=0.3)


@registered("""
WITH o AS (SELECT c_custkey AS object_id, CASE WHEN c_custkey % 3 = 0 THEN 'Block ' || n_name || ' 0' || (c_custkey % 9) WHEN c_custkey % 3 = 1 THEN ' ' || lower(n_name) || '! ' ELSE c_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k FROM o), s AS (SELECT n_nationkey AS site_id, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM nation),
e AS (SELECT object_id, min(site_id) AS site_id FROM k JOIN s ON k.k = s.n GROUP BY 1), c AS (SELECT object_id, min(site_id) AS site_id FROM k JOIN s ON length(s.n) >= 5 AND contains(k.k, s.n) GROUP BY 1)
SELECT o.object_id, coalesce(e.site_id, c.site_id) AS site_id, CASE WHEN e.site_id IS NOT NULL THEN 'name' WHEN c.site_id IS NOT NULL THEN 'contains' ELSE 'none' END AS matched_by FROM o LEFT JOIN e USING (object_id) LEFT JOIN c USING (object_id)""")
def name_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    named = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('Block ', n_name, ' 0', c_custkey % 9) WHEN c_custkey % 3 = 1 THEN concat(' ', lower(n_name), '! ') ELSE c_name END")
    sites = nation.select(F.col("n_nationkey").alias("site_id"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), F.lit("").alias("code"))
    return spatial.name_cascade(named.select(F.col("c_custkey").alias("object_id"), form.alias("name")), sites, S.match_key).select("object_id", "site_id", "matched_by")


# --- stems


@registered("SELECT tree_id, count(*) AS n_slices, max(CASE WHEN z_mid <= 1.3e0 AND 1.3e0 - z_mid <= 0.35e0 THEN z_mid END) AS z_lo, min(CASE WHEN z_mid >= 1.3e0 AND z_mid - 1.3e0 <= 0.35e0 THEN z_mid END) AS z_hi, min(abs(z_mid - 1.3e0)) AS gap FROM {slices} GROUP BY 1")
def asof_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems.bracket(recipe(spark, sf_dir, "slices"), ["tree_id"], F.lit(1.3)).select("tree_id", "n_slices", "z_lo", "z_hi", "gap")


@registered("SELECT tree_id, round(coalesce(avg(CASE WHEN abs(z_mid - 1.3e0) <= 0.4e0 THEN coverage_deg END), avg(coverage_deg)), 6) AS coverage_near, round(coalesce(avg(CASE WHEN abs(z_mid - 1.3e0) <= 0.4e0 THEN residual_m END), avg(residual_m)), 6) AS residual_near FROM {slices} GROUP BY 1")
def window_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stems.near_support(recipe(spark, sf_dir, "slices"), ["tree_id"], F.lit(1.3), coverage_near="coverage_deg", residual_near="residual_m"), "coverage_near", "residual_near")


@registered("""
WITH p AS (SELECT tree_id, z_mid AS z, radius_m AS r FROM {slices}), f AS (SELECT tree_id, min_by(r, (z, r)) AS r0, min(z) AS z0 FROM p GROUP BY 1 HAVING count(*) >= 2),
a AS (SELECT p.* FROM p SEMI JOIN f USING (tree_id) UNION ALL SELECT tree_id, 0e0, r0 * (1.12e0 / 2e0 + 0.5e0) FROM f WHERE z0 > 0.3e0),
n AS (SELECT *, lead(z) OVER w AS z1, lead(r) OVER w AS r1 FROM a WINDOW w AS (PARTITION BY tree_id ORDER BY z, r)), x AS (SELECT *, CASE WHEN r1 <= 0.035e0 AND r >= 0.035e0 AND r <> r1 THEN 1 ELSE 0 END AS x FROM n WHERE z1 IS NOT NULL),
s AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY tree_id ORDER BY z, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM x)
SELECT tree_id, round(sum((pi() * r * r + pi() * CASE WHEN x = 1 THEN 0.035e0 ELSE r1 END * CASE WHEN x = 1 THEN 0.035e0 ELSE r1 END) / 2e0 * ((z1 - z) * CASE WHEN x = 1 THEN (r - 0.035e0) / (r - r1) ELSE 1e0 END)), 6) AS volume_m3, count(*) AS n_sections FROM s WHERE stop = 0 GROUP BY 1""")
def smalian_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stems.smalian(recipe(spark, sf_dir, "slices"), ["tree_id"], "z_mid"), "volume_m3")


@registered("""
WITH s AS (SELECT CAST(l_suppkey AS BIGINT) AS tree_id, floor(l_quantity / 10e0) AS s, count(*) AS n, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5),
d AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM s WINDOW w AS (PARTITION BY tree_id ORDER BY s))
SELECT tree_id, count(*) AS n_slices, round(avg(d), 6) AS drift_mean, round(max(d), 6) AS drift_max FROM d GROUP BY 1""")
def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("tree_id"), F.col("l_quantity").alias("z"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    return rounded(stems.centroid_drift(points, ["tree_id"], 10.0), "drift_mean", "drift_max")


_SCORED = """
WITH a AS (SELECT *, greatest(0e0, least(1e0, (coverage_deg - 40e0) / 140e0)) * 0.50e0 + greatest(0e0, least(1e0, (residual_m - 0.070e0) / (0.010e0 - 0.070e0))) * 0.35e0 + greatest(0e0, least(1e0, (radius_m - 0.25e0) / (0.03e0 - 0.25e0))) * 0.15e0 AS s,
interior_ratio > 0.30e0 OR radius_m >= 0.25e0 AS bad FROM {slices}),
b AS (SELECT *, CASE WHEN bad THEN 0e0 ELSE s END AS slice_score, CASE WHEN bad THEN 'weak' WHEN s >= 0.65e0 AND n_points >= 8 THEN 'ring_good' WHEN s >= 0.25e0 AND n_points >= 6 THEN 'arc_usable' ELSE 'weak' END AS slice_class FROM a)
"""


@registered(_SCORED + "SELECT slice_class, count(*) AS n, round(avg(slice_score), 6) AS score_mean, count(DISTINCT tree_id) AS n_trees FROM b GROUP BY 1")
def slice_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stems.slice_score(recipe(spark, sf_dir, "slices"))
    return rounded(scored.groupBy("slice_class").agg(F.count(F.lit(1)).alias("n"), F.avg("slice_score").alias("score_mean"), F.count_distinct("tree_id").alias("n_trees")), "score_mean")


_WEIGHTED = _SCORED + """, m AS (SELECT *, median(radius_m) OVER w AS mr, min(z_mid) OVER w AS z0, max(z_mid) OVER w AS z1 FROM b WHERE slice_class <> 'weak' WINDOW w AS (PARTITION BY tree_id)),
c AS (SELECT *, CASE WHEN slice_class = 'ring_good' THEN 8e0 ELSE 0.2e0 END * greatest(0.25e0, least(1e0, coverage_deg / 180e0)) * greatest(0.25e0, 1e0 - least(residual_m / 0.08e0, 1e0)) * greatest(0.1e0, least(1e0, slice_score)) AS base, CASE WHEN z1 > z0 THEN (z_mid - z0) / (z1 - z0) ELSE 0e0 END AS zr FROM m),
v AS (SELECT *, base * greatest(0.5e0, least(2.5e0, pow(mr / radius_m, 1.5e0))) * greatest(0.7e0, least(1.6e0, 1.6e0 - zr * 0.9e0)) AS wr, base * greatest(0.9e0, least(1.25e0, 1.25e0 - zr * 0.35e0)) AS wc FROM c)
"""
_FITTED = _WEIGHTED + """, t AS (SELECT tree_id, count(*) AS n_slices_model, sum(wr * wr) AS sw, sum(wr * wr * z_mid) AS sx, sum(wr * wr * radius_m) AS sy, sum(wr * wr * z_mid * z_mid) AS sxx, sum(wr * wr * z_mid * radius_m) AS sxy, sum(wr * z_mid) / sum(wr) AS zm, sum(wr * radius_m) / sum(wr) AS rm,
min(z_mid) AS z_min_model, max(z_mid) AS z_max_model, pow(sum(wr), 2e0) / sum(wr * wr) AS eff_dof FROM v GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT *, greatest(-0.010e0, least(0.010e0, (sw * sxy - sx * sy) / (sw * sxx - sx * sx))) * 0.70e0 AS r_coef_1 FROM t WHERE z_max_model - z_min_model > 1e-2)
"""


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems.slice_weights(stems.slice_score(recipe(spark, sf_dir, "slices")).where("slice_class <> 'weak'"), ["tree_id"])


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems.taper_models(_accepted(spark, sf_dir), ["tree_id"]).where("z_max_model - z_min_model > 1e-2")


@registered(_FITTED + "SELECT tree_id, n_slices_model, round(r_coef_1, 6) AS r_coef_1, round(rm - r_coef_1 * zm, 6) AS r_coef_0, z_min_model, z_max_model, round(eff_dof, 5) AS eff_dof FROM f")
def taper_weighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(_models(spark, sf_dir), "r_coef_1", "r_coef_0").select("tree_id", "n_slices_model", "r_coef_1", "r_coef_0", "z_min_model", "z_max_model", "eff_dof")
    return rounded(out, "eff_dof", digits=5)


@registered(_FITTED + """, h AS (SELECT DISTINCT CASE WHEN i = 23 THEN 1.3e0 ELSE round(0.5e0 + i * 0.2e0, 2) END AS z_m FROM range(24) r(i)),
q AS (SELECT f.tree_id, h.z_m, f.rm - f.r_coef_1 * f.zm AS r0, f.r_coef_1 AS r1 FROM f CROSS JOIN h),
j AS (SELECT q.tree_id, q.z_m, r0, r1, min(abs(v.z_mid - q.z_m)) AS g, min(CASE WHEN v.z_mid <= q.z_m THEN abs(v.z_mid - q.z_m) END) AS lo, min(CASE WHEN v.z_mid >= q.z_m THEN abs(v.z_mid - q.z_m) END) AS hi FROM q LEFT JOIN v USING (tree_id) GROUP BY ALL)
SELECT tree_id, z_m, round(greatest(r0 + r1 * z_m, 0.035e0) * 200e0, 5) AS diameter_cm, CASE WHEN g <= 0.12e0 THEN 'direct' WHEN lo <= 0.35e0 AND hi <= 0.35e0 THEN 'interpolated' ELSE 'model_only' END AS diameter_source FROM j""")
def profile_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stems.profile(_models(spark, sf_dir), _accepted(spark, sf_dir), ["tree_id"])
    return rounded(found.select("tree_id", "z_m", "diameter_cm", "diameter_source"), "diameter_cm", digits=5)


@registered("""
WITH l AS (SELECT o_custkey AS tree_id, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 400 AS BIGINT) END AS s, CAST(o_orderkey % 97 + 1 AS BIGINT) AS n FROM orders),
r AS (SELECT *, count(s) OVER (PARTITION BY tree_id ORDER BY k) AS run FROM l)
SELECT tree_id, k, coalesce(first_value(s) OVER w, 0) + CAST(coalesce(sum(n) OVER (PARTITION BY tree_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at,
coalesce(first_value(s) OVER w, 0) + CAST(coalesce(sum(n) OVER (PARTITION BY tree_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + n AS end_at FROM r WINDOW w AS (PARTITION BY tree_id, run ORDER BY k)""")
def log_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS tree_id", "o_orderkey AS k", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 400 END AS s", "o_orderkey % 97 + 1 AS n")
    return stems.log_positions(logs, ["tree_id"], "k", "s", "n").select("tree_id", "k", "start_at", "end_at")


# --- statistics and tariff


@registered("""
WITH f AS (SELECT p_size AS grp, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1)
SELECT p_size AS p_size, count(*) AS n, round(coalesce(avg(CASE WHEN n < 4 OR abs(p_retailprice - m) <= s * 1.5e0 THEN p_retailprice END), avg(p_retailprice)), 6) AS robust_mean, count(*) FILTER (WHERE NOT (n < 4 OR abs(p_retailprice - m) <= s * 1.5e0)) AS n_dropped FROM part JOIN f ON f.grp = p_size GROUP BY 1""")
def robust_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.robust_mean(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice"), "p_retailprice", ["p_size"], 1.5), "robust_mean")


@registered("""
WITH t AS (SELECT * FROM {trees} WHERE dbh_cm IS NOT NULL AND height_m IS NOT NULL)
SELECT compartment, round(regr_slope(dbh_cm, height_m), 6) AS slope, round(regr_intercept(dbh_cm, height_m), 5) AS intercept, round(regr_r2(dbh_cm, height_m), 6) AS r2, CAST(regr_count(dbh_cm, height_m) AS BIGINT) AS n FROM t GROUP BY 1""")
def dbh_height_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recipe(spark, sf_dir, "trees").groupBy("compartment").agg(*stats.line_fit("dbh_cm", "height_m"))
    return rounded(rounded(found, "slope", "r2"), "intercept", digits=5)


@registered("SELECT dbh_status, count(dbh_cm) AS n, min(dbh_cm) AS v_min, max(dbh_cm) AS v_max, round(avg(dbh_cm), 6) AS v_mean, round(stddev_pop(dbh_cm), 6) AS v_std, round(quantile_cont(dbh_cm, 0.25), 6) AS v_p25, round(median(dbh_cm), 6) AS v_median, round(quantile_cont(dbh_cm, 0.75), 6) AS v_p75 FROM {trees} GROUP BY 1")
def stand_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(recipe(spark, sf_dir, "trees"), "dbh_cm", ["dbh_status"]), "v_mean", "v_std", "v_p25", "v_median", "v_p75")


_TARIFF = """
WITH t AS (SELECT *, dbh_cm * dbh_cm * pi() / 40000e0 AS ba, height_m * 100e0 / dbh_cm AS sl, coalesce(dbh_cm > 0, false) AS me FROM {trees}),
s0 AS (SELECT *, ba * height_m * 0.42e0 AS v, ba - 0.118288e0 AS g FROM t WHERE me AND dbh_status <> 'dbh_unsupported' AND dbh_confidence >= 0.40e0 AND coalesce(sl, 1e9) >= 60e0),
s AS (SELECT *, CASE WHEN abs(g * 0.315049301e0 + 0.0360541e0) >= 1e-12 THEN (v + g * (0.315049301e0 * 0.138763302e0)) / (g * 0.315049301e0 + 0.0360541e0) END AS tn, height_m * 1.771173e0 + 8.292030e0 - dbh_cm * 0.416509e0 AS th FROM s0),
k AS (SELECT *, CASE WHEN th > 0 THEN th END AS h FROM s WHERE tn > 0),
r1 AS (SELECT avg(tn) AS m, stddev_pop(tn) AS d, count(tn) AS n, avg(h) AS mh, stddev_pop(h) AS dh, count(h) AS nh FROM k),
st AS (SELECT avg(CASE WHEN n < 4 OR abs(tn - m) <= d * 2.5e0 THEN tn END) AS stand, avg(CASE WHEN nh < 4 OR abs(h - mh) <= dh * 2.5e0 THEN h END) AS stand_h FROM k, r1),
r2 AS (SELECT compartment, avg(tn) AS m, stddev_pop(tn) AS d, count(tn) AS n FROM k WHERE compartment IS NOT NULL GROUP BY 1),
ow AS (SELECT compartment, avg(CASE WHEN abs(tn - m) <= d * 2.5e0 THEN tn END) AS own FROM k JOIN r2 USING (compartment) WHERE r2.n >= 4 GROUP BY 1),
ft AS (SELECT regr_slope(dbh_cm, height_m) AS a, regr_intercept(dbh_cm, height_m) AS b FROM t WHERE me AND height_m IS NOT NULL), mn AS (SELECT avg(dbh_cm) AS mean FROM t WHERE me),
q AS (SELECT t.*, own, stand, stand_h, mean, CASE WHEN a * height_m + b > 0 THEN a * height_m + b ELSE mean END AS fh, CASE WHEN me AND height_m IS NOT NULL AND sl < 60e0 THEN 'hd_model' WHEN me AND dbh_status = 'dbh_unsupported' THEN 'circle_fit_weak' WHEN me THEN 'circle_fit_filtered' WHEN height_m IS NOT NULL THEN 'hd_model' ELSE 'stand_mean' END AS tier FROM t CROSS JOIN st CROSS JOIN ft CROSS JOIN mn LEFT JOIN ow USING (compartment)),
u AS (SELECT *, CASE WHEN tier = 'hd_model' THEN fh WHEN tier = 'stand_mean' THEN mean ELSE dbh_cm END AS d1, coalesce(own, stand) AS tariff FROM q),
w AS (SELECT *, d1 * d1 * pi() / 40000e0 AS b1 FROM u),
vol AS (SELECT *, CASE WHEN d1 > 0 AND d1 < 7 THEN 0e0 ELSE greatest(0e0, tariff * 0.0360541e0 - (tariff - 0.138763302e0) * 0.315049301e0 * 0.118288e0 + (tariff - 0.138763302e0) * 0.315049301e0 * b1) END AS vm,
CASE WHEN d1 > 0 AND d1 < 7 THEN 0e0 ELSE greatest(0e0, stand_h * 0.0360541e0 - (stand_h - 0.138763302e0) * 0.315049301e0 * 0.118288e0 + (stand_h - 0.138763302e0) * 0.315049301e0 * b1) END AS vh FROM w)
"""


@registered(_TARIFF + "SELECT tree_id, tier, round(tariff, 5) AS tariff, round(d1, 5) AS dbh_cm, round(vm, 5) AS volume_m3, round(vh, 5) AS volume_height_m3 FROM vol")
def tariff_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tariff.tree_tariffs(recipe(spark, sf_dir, "trees"), None)
    return rounded(found.select("tree_id", "tier", "tariff", "dbh_cm", "volume_m3", "volume_height_m3"), "tariff", "dbh_cm", "volume_m3", "volume_height_m3", digits=5)


@registered(_TARIFF + """SELECT count(*) AS n_trees, round(sum(vm), 3) AS volume_m3, round(sum(vh), 3) AS volume_height_m3, round(sum(CASE WHEN tier = 'circle_fit_filtered' THEN vm ELSE 0e0 END), 3) AS volume_primary_m3, round(sum(CASE WHEN tier <> 'circle_fit_filtered' THEN vm ELSE 0e0 END), 3) AS volume_augmented_m3,
count(*) FILTER (WHERE tier = 'circle_fit_filtered') AS n_samples, round(avg(dbh_cm), 5) AS dbh_mean, count(*) FILTER (WHERE tier = 'hd_model') AS n_hd_model, count(*) FILTER (WHERE tier = 'circle_fit_weak') AS n_weak, count(*) FILTER (WHERE tier = 'stand_mean') AS n_stand_mean,
CASE WHEN count(*) FILTER (WHERE tier = 'circle_fit_filtered') >= 13 THEN 'high' WHEN count(*) FILTER (WHERE tier = 'circle_fit_filtered') >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM vol""")
def tariff_stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tariff.stand_rollup(tariff.tree_tariffs(recipe(spark, sf_dir, "trees"), None))
    return rounded(rounded(found, "volume_m3", "volume_height_m3", "volume_primary_m3", "volume_augmented_m3", digits=3), "dbh_mean", digits=5)


@registered(_TARIFF + """, c AS (SELECT * FROM (VALUES (0, 10e0), (1, 20e0), (2, 30e0), (3, 40e0), (9, 50e0)) c(compartment, area)), g AS (SELECT compartment, count(*) AS n, sum(vm) AS v, sum(vh) AS h, avg(dbh_cm) AS dm, avg(height_m) AS hm, sum(CASE WHEN tier LIKE 'circle%' THEN vm ELSE 0e0 END) AS vc, count(*) FILTER (WHERE tier = 'circle_fit_filtered') AS ns, bool_or(own IS NOT NULL) AS o FROM vol WHERE compartment IS NOT NULL GROUP BY 1)
SELECT CAST(c.compartment AS BIGINT) AS compartment, coalesce(n, 0) AS n_trees, round(coalesce(v, 0e0), 3) AS volume_m3, round(coalesce(h, 0e0), 3) AS volume_height_m3, round(dm, 5) AS dbh_mean, round(hm, 5) AS height_mean, round(coalesce(vc, 0e0), 3) AS volume_measured_m3, round(v / area, 4) AS volume_per_ha, CASE WHEN NOT coalesce(o, false) THEN 'inherited' WHEN ns >= 13 THEN 'high' ELSE 'medium' END AS confidence FROM c LEFT JOIN g USING (compartment)""")
def tariff_compartment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0), (3, 40.0), (9, 50.0)], "compartment long, area_hectares double")
    found = tariff.compartment_rollup(tariff.tree_tariffs(recipe(spark, sf_dir, "trees"), None), parts)
    return rounded(rounded(rounded(found, "volume_m3", "volume_height_m3", "volume_measured_m3", digits=3), "dbh_mean", "height_mean", digits=5), "volume_per_ha", digits=4)


# --- harvest


@registered("""
WITH b AS (SELECT object_id, count(*) AS n, quantile_cont(lon * 111320e0 * cos(radians(lat)), 0.99) - quantile_cont(lon * 111320e0 * cos(radians(lat)), 0.01) AS w, quantile_cont(lat * 111320e0, 0.99) - quantile_cont(lat * 111320e0, 0.01) AS h, median(dbh_cm) AS d, median(stem_volume_m3) AS v FROM {stems} GROUP BY 1)
SELECT object_id, n AS n_stems, round(w * h / 1e4, 3) AS area_ha, round(n / greatest(w * h / 1e4, 0.01e0), 5) AS stems_per_ha, d AS dbh_median, round(v, 6) AS volume_median FROM b""")
def coupe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harvest.coupe_context(recipe(spark, sf_dir, "stems"))
    return rounded(rounded(rounded(found, "area_ha", digits=3), "stems_per_ha", digits=5), "volume_median")


@registered("WITH b AS (SELECT floor(dbh_cm / 2e0) * 2e0 AS dbh_bin, quantile_cont(canopy_m, 0.9) AS e FROM {stems} GROUP BY 1) SELECT stem_key, b.dbh_bin, round(e, 6) AS envelope_m, round(greatest(e - canopy_m, 0e0), 6) AS deficit_m FROM {stems} s JOIN b ON b.dbh_bin = floor(s.dbh_cm / 2e0) * 2e0")
def canopy_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(harvest.canopy_deficit(recipe(spark, sf_dir, "stems")).select("stem_key", "dbh_bin", "envelope_m", "deficit_m"), "envelope_m", "deficit_m")


_QUOTE = """
WITH l AS (SELECT regr_slope(log_cycle, ln(stem_volume_m3)) AS a, regr_intercept(log_cycle, ln(stem_volume_m3)) AS b FROM {stems} WHERE stem_volume_m3 > 0),
c AS (SELECT s.*, exp(log_cycle * 0.7e0 + (a * ln(greatest(stem_volume_m3, 1e-3)) + b) * (1 - 0.7e0)) AS cy FROM {stems} s CROSS JOIN l),
q AS (SELECT object_id, count(*) AS n_stems, sum(stem_volume_m3) AS v, sum(cy) / 3600e0 AS ch, median(dbh_cm) AS d FROM c GROUP BY 1),
z AS (SELECT *, ch / 0.70e0 + v / 16.5e0 AS mh, v * (1.02e0 + 0.90e0) AS fl, d < 16 AS wb FROM q), y AS (SELECT *, mh * 150e0 + fl * 1.30e0 AS cost, CASE WHEN wb THEN 0.30e0 ELSE 0.18e0 END AS band FROM z)
"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.coupe_quotes(harvest.blended_cycles(recipe(spark, sf_dir, "stems")))


@registered(_QUOTE + "SELECT object_id, n_stems, round(v, 3) AS volume_m3, round(ch, 4) AS cut_h, round(v / ch, 4) AS m3_per_pmh, round(mh, 3) AS machine_h, round(fl, 3) AS fuel_l, wb AS windblow, band, round(cost, 2) AS cost, round(cost * (1 - band), 2) AS cost_low, round(cost * (1 + band), 2) AS cost_high FROM y")
def quote_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _quotes(spark, sf_dir).drop("dbh_median")
    return rounded(rounded(rounded(found, "volume_m3", "machine_h", "fuel_l", digits=3), "cut_h", "m3_per_pmh", digits=4), "cost", "cost_low", "cost_high", digits=2)


@registered(_QUOTE + "SELECT count(*) AS n_coupes, CAST(sum(n_stems) AS BIGINT) AS n_stems, round(sum(v), 2) AS volume_m3, round(sum(mh), 2) AS machine_h, round(sum(fl), 2) AS fuel_l, round(sum(cost), 1) AS cost, CASE WHEN bool_or(wb) THEN 0.30e0 ELSE 0.18e0 END AS band FROM y")
def quote_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(harvest.quote_total(_quotes(spark, sf_dir)), "volume_m3", "machine_h", "fuel_l", digits=2), "cost", digits=1)


# --- feed


@registered("SELECT f.file_name, f.object_id FROM {files} f ANTI JOIN (SELECT file_name FROM {files} WHERE volume_cm3 % 3 = 0) l ON l.file_name = f.file_name")
def ledger_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = recipe(spark, sf_dir, "files")
    return feed.fresh_files(files, files.where("volume_cm3 % 3 = 0")).select("file_name", "object_id")


@registered("SELECT object_id, count(*) AS n_files, CAST(sum(volume_cm3) AS BIGINT) AS volume, min(file_time) AS first_at, max(file_time) AS last_at, array_to_string(list_sort(list(DISTINCT machine)), ',') AS machines FROM {files} GROUP BY 1")
def feed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.rollup(recipe(spark, sf_dir, "files"), ["object_id"], "file_time", "volume_cm3", "machine")
    return found.withColumn("machines", F.array_join("machines", ","))


@registered("SELECT object_id, count(*) AS n_files, CAST(sum(volume_cm3) AS BIGINT) AS volume, array_to_string(list_sort(list(DISTINCT machine)), ',') AS machines FROM {files} GROUP BY 1")
def feed_rollup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = recipe(spark, sf_dir, "files")
    parts = [feed.rollup(files.where(f"volume_cm3 % 2 {op} 0"), ["object_id"], "file_time", "volume_cm3", "machine") for op in ("=", "<>")]
    return feed.merged_rollup(*parts, ["object_id"]).select("object_id", "n_files", "volume", F.array_join("machines", ",").alias("machines"))


@registered("SELECT object_id, file_name, file_time, volume_cm3 FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY file_time DESC, file_name DESC) AS k FROM {files}) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest(recipe(spark, sf_dir, "files"), ["object_id"], [F.col("file_time"), F.col("file_name")]).select("object_id", "file_name", "file_time", "volume_cm3")


@registered("SELECT object_id, machine, total FROM (SELECT object_id, machine, CAST(sum(volume_cm3) AS BIGINT) AS total, row_number() OVER (PARTITION BY object_id ORDER BY sum(volume_cm3) DESC, machine) AS k FROM {files} GROUP BY 1, 2) WHERE k = 1")
def primary_assortment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.argmax_share(recipe(spark, sf_dir, "files"), ["object_id"], "machine", "volume_cm3")


@registered("""
WITH r AS (SELECT * FROM (VALUES ('block 1', 'linked', 7), ('block 2', 'ignored', NULL), ('block 3', 'linked', NULL)) r(object_key, status, site)), o AS (SELECT object_id, CASE WHEN object_id % 5 = 0 THEN 'Other' ELSE 'Block--' || (object_id % 5) END AS name FROM (SELECT DISTINCT object_id FROM {files}))
SELECT object_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS object_key, CASE WHEN status = 'ignored' THEN 'ignored' WHEN status = 'linked' AND site IS NOT NULL THEN 'linked' ELSE 'pending' END AS route, CASE WHEN status = 'linked' THEN site END AS site_id FROM o LEFT JOIN r ON r.object_key = trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))""")
def feed_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("block 1", "linked", 7), ("block 2", "ignored", None), ("block 3", "linked", None)], "object_key string, status string, site_id int")
    objects = recipe(spark, sf_dir, "files").select("object_id").distinct().withColumn("object_name", F.expr("CASE WHEN object_id % 5 = 0 THEN 'Other' ELSE concat('Block--', object_id % 5) END"))
    return feed.routed(objects, rules).select("object_id", "object_key", "route", "site_id")


@registered("""
WITH o AS (SELECT o_custkey * 8 + o_orderkey % 8 AS site_id, o_orderkey AS operation_id, o_orderstatus = 'O' AND o_orderkey % 7 = 0 AS b FROM orders)
SELECT site_id, CASE WHEN count(*) FILTER (WHERE b) = 1 THEN max(CASE WHEN b THEN operation_id END) WHEN count(*) = 1 THEN max(operation_id) END AS operation_id FROM o GROUP BY 1""")
def operation_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey * 8 + o_orderkey % 8 AS site_id", "o_orderkey AS operation_id", "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'in_progress' ELSE 'planned' END AS status")
    return feed.operation_link(made)


@registered("""
SELECT a AS present_in, b AS missing_in, n FROM (SELECT 'orders' AS a, 'lines' AS b, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS n UNION ALL SELECT 'lines', 'orders', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)))""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")), "lines": spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"))}
    return stats.set_differences(sets, "k")


# --- scalar functions


@registered("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(p_brand || ' (' || p_type || ')', '[^a-zA-Z0-9_.-]+', '_', 'g') AS file FROM part")
def key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", S.match_key(F.col("p_name")).alias("key"), S.safe_file_name(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).alias("file"))


@registered("""
WITH n AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'odd name.HPR' ELSE user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.hpr' END AS name FROM events)
SELECT event_id, nullif(regexp_extract(name, '^(\\d+)_(\\d{8})_(\\d{6})\\.(\\w+)$', 1), '') AS machine, try_strptime(nullif(regexp_extract(name, '^(\\d+)_(\\d{8})_(\\d{6})\\.(\\w+)$', 2) || regexp_extract(name, '^(\\d+)_(\\d{8})_(\\d{6})\\.(\\w+)$', 3), ''), '%Y%m%d%H%M%S') AS file_time, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS file_type FROM n""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("CASE WHEN event_id % 4 = 0 THEN 'odd name.HPR' ELSE concat(user_id, '_', date_format(ts, 'yyyyMMdd_HHmmss'), '.hpr') END").alias("name"))
    parts = S.feed_file_parts(F.col("name"))
    return named.select("event_id", *(c.alias(n) for n, c in parts.items())).withColumn("file_time", F.col("file_time").cast("timestamp_ntz"))


@registered("SELECT c_custkey, floor(c_acctbal / 1e1 + 0.5e0) * 1e0 AS half_up, round_even(c_acctbal / 1e1, 0) AS half_even, CAST(floor(c_acctbal / 1e2) AS INT) AS cell, greatest(0e0, least(1e0, c_acctbal / 5e3)) AS score FROM customer")
def rounding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_acctbal")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", S.round_half_up(v / 10.0).alias("half_up"), S.round_half_even(v / 10.0).alias("half_even"), S.cell_of(v, 100.0).alias("cell"), S.clamp(v / 5000.0, 0.0, 1.0).alias("score"))


# --- algorithms, streams and files


@registered()
def nms_treetops(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = recipe(spark, sf_dir, "spots").select(F.col("point_id").alias("tree_id"), "x", "y", F.col("z").alias("height_m"))
    return segments.suppressed(tops, 30.0)


@registered()
def watershed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = _surface(spark, sf_dir)
    seeds = grid.local_maxima(surface, 2).select("row", "col", F.xxhash64("row", "col").alias("label"))
    return segments.watershed(surface, seeds, tile=20, halo=8)


@registered()
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.smoothed(_surface(spark, sf_dir)), "value")


@registered()
def priority_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.priority_flood(_surface(spark, sf_dir).withColumn("site", F.lit(1)), "site")


@registered()
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    flooded = terrain.priority_flood(_surface(spark, sf_dir).withColumn("site", F.lit(1)), "site").drop("site")
    return terrain.flow_accumulation(flooded, 20.0)


@registered()
def drainage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.drainage_summary(flow_accumulation(spark, sf_dir), 20.0)


@registered()
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.radians(F.col("l_partkey") % 360)
    radius = F.lit(0.12) + F.col("l_discount") / 50.0
    ring = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 50).alias("tree_id"), F.col("l_linenumber").alias("slice"), (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))
    return rounded(circles.slice_fits(ring, ["tree_id", "slice"]), "cx", "cy", "radius_m", "residual_m")


@registered()
def linearity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = recipe(spark, sf_dir, "spots").select(F.col("grp").alias("tree_id"), "point_id", "x", "y", "z")
    return rounded(segments.linearity(points, "tree_id"), "linearity")


@registered()
def segment_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.principal_axes(recipe(spark, sf_dir, "spots").select(F.col("grp").alias("tree_id"), "x", "y", "z"), "tree_id"), "linearity", "verticality")


@registered()
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.convex_hulls(recipe(spark, sf_dir, "spots").select("grp", "x", "y"), "grp").select("grp", F.posexplode("hull").alias("place", "p")).select("grp", "place", "p.x", "p.y")


@registered()
def ground_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.ground_points(recipe(spark, sf_dir, "points"), 20.0, slope=0.05, first=2.0).groupBy("is_ground").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@registered()
def dtm_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = _surface(spark, sf_dir).where("(row * 7 + col * 3) % 5 <> 0")
    return rounded(terrain.filled_surface(surface), "value")


@registered("SELECT object_id, count(*) AS n_files, CAST(sum(volume_cm3) AS BIGINT) AS volume, array_to_string(list_sort(list(DISTINCT machine)), ',') AS machines FROM {files} GROUP BY 1")
def feed_stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, select = RECIPES["files"]
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    files = events.selectExpr(*(part.strip() for part in select.split(", ")))
    return feed_stream.rolled_up_stream(files, ["object_id"]).select("object_id", "n_files", "volume", F.array_join("machines", ",").alias("machines"))


@registered("SELECT file_name, object_id, volume_cm3 + CASE WHEN volume_cm3 % 2 = 0 AND object_id % 3 = 0 THEN 1 ELSE 0 END AS volume_cm3 FROM {files}")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = recipe(spark, sf_dir, "files").select("file_name", "object_id", "volume_cm3")
    new = files.where("object_id % 3 = 0").withColumn("volume_cm3", F.col("volume_cm3") + F.when(F.col("volume_cm3") % 2 == 0, 1).otherwise(0))
    return feed.replaced(files, new, ["file_name"])


@registered("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS kind, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'own' END, c_name) AS model FROM customer")
def fill_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    current = customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE ' ' END AS kind", "CASE WHEN c_custkey % 2 = 0 THEN 'own' END AS model")
    found = customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS kind", "CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'own' ELSE c_name END AS model")
    return feed.filled_blanks(current, found, "c_custkey")


# --- further stem, feed and scalar operators


@registered(_FITTED + """, br AS (SELECT tree_id, count(*) AS n, max(CASE WHEN z_mid <= 1.3e0 AND 1.3e0 - z_mid <= 0.25e0 THEN (z_mid, radius_m) END) AS lo, min(CASE WHEN z_mid >= 1.3e0 AND z_mid - 1.3e0 <= 0.25e0 THEN (z_mid, radius_m) END) AS hi, min((abs(z_mid - 1.3e0), z_mid, radius_m)) AS near FROM v GROUP BY 1),
ci AS (SELECT tree_id, n, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN hi[1] > lo[1] THEN lo[2] + (hi[2] - lo[2]) * (1.3e0 - lo[1]) / (hi[1] - lo[1]) ELSE lo[2] END END AS i, near[1] AS g, near[3] AS vn FROM br),
de AS (SELECT ci.*, greatest(f.z_min_model - 1.3e0, 1.3e0 - f.z_max_model, 0e0) AS mg, greatest(rm - r_coef_1 * zm + r_coef_1 * 1.3e0, 0e0) AS m FROM ci LEFT JOIN f USING (tree_id))
SELECT tree_id, n AS n_slices, round(200e0 * CASE WHEN i IS NOT NULL THEN i WHEN g <= 0.25e0 THEN vn WHEN mg <= 1.5e0 THEN m END, 5) AS dbh_cm, CASE WHEN i IS NOT NULL THEN 'interpolated' WHEN g <= 0.25e0 THEN 'nearest' WHEN mg <= 1.5e0 THEN 'model_taper' ELSE 'none' END AS dbh_source,
CASE WHEN i IS NOT NULL THEN 0e0 WHEN g <= 0.25e0 THEN round(g, 6) WHEN mg <= 1.5e0 THEN round(mg, 6) END AS dbh_gap_m FROM de""")
def dbh_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stems.breast_diameter(_accepted(spark, sf_dir), _models(spark, sf_dir), ["tree_id"])
    return rounded(rounded(found, "dbh_cm", digits=5), "dbh_gap_m")


@registered(_SCORED + """, t AS (SELECT tree_id, count(*) AS n_slices, avg(coverage_deg) AS cm, avg(residual_m) AS rm, stddev_pop(radius_m) * 100e0 AS sd, count(*) FILTER (WHERE slice_class = 'ring_good') AS ng, count(*) FILTER (WHERE slice_class = 'arc_usable') AS na,
coalesce(avg(CASE WHEN abs(z_mid - 1.3e0) <= 0.4e0 THEN coverage_deg END), avg(coverage_deg)) AS cn, max(radius_m) * 200e0 AS d FROM b GROUP BY 1)
SELECT tree_id, round(greatest(0e0, least(1e0, cm / 180e0)) * greatest(0e0, 1e0 - least(rm / 0.08e0, 1e0)) * greatest(0e0, 1e0 - least(sd / 1e1, 1e0)) * CASE WHEN ng = 0 THEN 1e0 - least(0.5e0 / 1.5e0, 1e0) * 0.40e0 ELSE 1e0 END * greatest(0.5e0, least(cn / 180e0, 1e0)), 5) AS dbh_confidence,
CASE WHEN n_slices < 3 THEN 'insufficient_slices' WHEN ng >= 3 THEN 'good' WHEN ng >= 1 THEN 'limited_support' WHEN na >= 3 THEN 'partial_arc' ELSE 'no_consensus' END AS status FROM t""")
def dbh_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stems.slice_score(recipe(spark, sf_dir, "slices"))
    kinds = F.col("slice_class")
    per_tree = scored.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_slices"), F.avg("coverage_deg").alias("coverage_mean"), F.avg("residual_m").alias("residual_mean"), (F.stddev_pop("radius_m") * 100.0).alias("radius_sd_cm"), F.count_if(kinds == "ring_good").alias("n_ring_good"), F.count_if(kinds == "arc_usable").alias("n_arc_usable"), (F.max("radius_m") * 200.0).alias("dbh_cm"))
    near = stems.near_support(scored, ["tree_id"], F.lit(1.3), coverage_near="coverage_deg")
    all_ = per_tree.join(near, "tree_id").withColumns({"dbh_source": F.when(F.col("n_ring_good") == 0, "model_taper").otherwise("interpolated"), "dbh_gap_m": F.lit(0.5)})
    return rounded(stems.dbh_status(stems.dbh_confidence(all_)).select("tree_id", "dbh_confidence", "status"), "dbh_confidence", digits=5)


@registered("SELECT grp, count(DISTINCT floor(CASE WHEN degrees(atan2(y - 500e0, x - 500e0)) < 0 THEN degrees(atan2(y - 500e0, x - 500e0)) + 360e0 ELSE degrees(atan2(y - 500e0, x - 500e0)) END / 1e1)) * 1e1 AS coverage_deg, count(*) AS n_points FROM {spots} GROUP BY 1")
def angular_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = recipe(spark, sf_dir, "spots").withColumns({"cx": F.lit(500.0), "cy": F.lit(500.0)})
    return stems.angular_coverage(points, ["grp"], "cx", "cy")


@registered("""
WITH p AS (SELECT point_id, grp AS tree_id, x, y FROM {spots}), n AS (SELECT *, (x - 500e0) * (x - 500e0) + (y - 500e0) * (y - 500e0) <= 62500e0 AS near FROM p), c AS (SELECT tree_id, count(*) FILTER (WHERE near) AS k, count(*) AS n FROM n GROUP BY 1)
SELECT point_id, near OR k < 10 AS kept, CASE WHEN k < 10 THEN 1e0 ELSE k / CAST(n AS DOUBLE) END AS retention FROM n JOIN c USING (tree_id)""")
def radial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = recipe(spark, sf_dir, "spots").select("point_id", F.col("grp").alias("tree_id"), "x", "y")
    centres = points.select("tree_id").distinct().withColumns({"x": F.lit(500.0), "y": F.lit(500.0)})
    return segments.radial_filter(points, centres, radius=250.0).select("point_id", "kept", "retention")


@registered("SELECT p.point_id, CASE WHEN count(*) OVER (PARTITION BY grp) < 60 THEN 0 ELSE grp END AS grp FROM {spots} p")
def small_groups_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.dense_enough(recipe(spark, sf_dir, "spots").select("point_id", "grp"), "grp", 60)


@registered("""
SELECT point_id, CAST(k AS INT) AS rank, d AS distance FROM (SELECT a.point_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS k FROM {spots} a JOIN {spots} b ON a.grp = b.grp AND a.point_id <> b.point_id) WHERE k <= 5""")
def nearest_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = recipe(spark, sf_dir, "spots").select("grp", "point_id", "x", "y")
    found = spatial.nearest_in_group(points, ["grp"], "point_id", ["x", "y"], 5)
    return found.select("point_id", F.posexplode("distances").alias("at", "distance")).select("point_id", (F.col("at") + 1).alias("rank"), "distance")


@registered("""
WITH s AS (SELECT object_id, stem_key, stem_volume_m3 - 1e0 AS v, CASE WHEN stem_key % 4 = 0 THEN 0e0 ELSE dbh_cm END AS d FROM {stems}), m AS (SELECT object_id, avg(CASE WHEN d > 0 THEN d END) AS mean FROM s WHERE v > 0 GROUP BY 1)
SELECT stem_key, round(coalesce(CASE WHEN d > 0 THEN d END, mean), 6) AS dbh_cm FROM s JOIN m USING (object_id) WHERE v > 0""")
def imputed_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = recipe(spark, sf_dir, "stems").select("object_id", "stem_key", (F.col("stem_volume_m3") - 1.0).alias("stem_volume_m3"), F.when(F.col("stem_key") % 4 == 0, 0.0).otherwise(F.col("dbh_cm")).alias("dbh_cm"))
    return rounded(harvest.with_volume(raw).select("stem_key", "dbh_cm"), "dbh_cm")


@registered("""
WITH s AS (SELECT object_id, stem_key FROM {stems}), t AS (SELECT o_custkey % 25 AS object_id, o_orderkey AS stem_key, max_by(o_totalprice, o_totalprice) AS elev FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2)
SELECT stem_key, elev AS elev_m FROM s LEFT JOIN t USING (object_id, stem_key)""")
def terrain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    terrain_rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 > 0").selectExpr("o_custkey % 25 AS object_id", "o_orderkey AS stem_key", "o_totalprice AS elev_m", "o_totalprice AS at")
    merged, _ = harvest.merge_terrain(recipe(spark, sf_dir, "stems").select("object_id", "stem_key"), terrain_rows, "at")
    return merged.select("stem_key", "elev_m")


@registered("""
SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE THEN 'failed' ELSE event_type END AS status FROM events""")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_type").alias("name"))
    coded = jobs.withColumn("status", F.when(F.col("name").isin("view", "click"), "ready").otherwise("queued"))
    swept = feed.orphans_failed(coded, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return swept.select("event_id", F.when(F.col("status") == "failed", "failed").otherwise(F.col("name")).alias("status"))


@registered("SELECT DISTINCT user_id AS machine_id, date_trunc('minute', ts) AS recorded_at FROM events WHERE user_id % 4 <> 0")
def positions_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("machine_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("recorded_at"))
    return feed.ignored_conflicts(seen.where("machine_id % 4 = 0"), seen, ["machine_id", "recorded_at"]).select("machine_id", "recorded_at")


@registered("""
SELECT p_partkey, trim(regexp_replace(trim(' "' || p_name || '" '), '^[''"]|[''"]$', '', 'g')) AS name, CASE WHEN contains(lower(p_type), 'steel') THEN 'spruce' ELSE lower(trim(p_type)) END AS species,
CASE WHEN p_partkey % 4 = 0 THEN 'harvester' WHEN p_partkey % 4 = 1 THEN 'forwarder' WHEN p_partkey % 4 = 2 THEN 'skidder' ELSE 'other' END AS kind, coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_brand END), ''), p_type) AS filled, substr(p_name, 1, 5) AS short,
CASE WHEN p_partkey % 3 = 0 THEN p_size * 5e-1 END AS number FROM part""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.array(F.lit("Big Harvester X"), F.lit("forwarder 2"), F.lit("SKIDDER"), F.lit("truck")), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.element_at(F.array((F.col("p_size") * 0.5).cast("string"), F.lit("n/a?"), F.lit(" NaN ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    spruce = F.when(F.lower("p_type").contains("steel"), F.lit("Sitka Spruce")).otherwise(F.col("p_type"))
    return part.select("p_partkey", S.unquote(F.concat(F.lit(' "'), "p_name", F.lit('" '))).alias("name"), S.folded_species(spruce).alias("species"), S.machine_kind(kind).alias("kind"), S.first_filled(F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(F.col("p_brand")), F.col("p_type")).alias("filled"), S.truncated(F.col("p_name"), 5).alias("short"), S.number_or_null(raw).alias("number"))


@registered("""
WITH c AS (SELECT c_custkey, (c_custkey * 7919) % 900000 - 50000 AS e, (c_custkey * 104729) % 1500000 - 50000 AS n FROM customer), i AS (SELECT *, CAST(floor(e / 1e5) AS INT) AS ei, CAST(floor(n / 1e5) AS INT) AS ni FROM c)
SELECT c_custkey, CASE WHEN e >= 0 AND e < 700000 AND n >= 0 AND n < 1300000 THEN substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', (19 - ni) - (19 - ni) % 5 + (ei + 10) // 5 + 1, 1) || substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', (19 - ni) * 5 % 25 + ei % 5 + 1, 1) || CAST(e % 100000 // 10000 AS STRING) || CAST(n % 100000 // 10000 AS STRING) END AS tile_ref FROM i""")
def grid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "(c_custkey * 7919) % 900000 - 50000 AS e", "(c_custkey * 104729) % 1500000 - 50000 AS n")
    return c.select("c_custkey", S.grid_reference(F.col("e"), F.col("n")).alias("tile_ref"))


# --- labels, populations, checks and the feed's tables


_LABELS = "element_at(array('SS', ' Sitka Spruce ', 'scotspine', 'DOUGLAS', 'Larch', 'hybrid larch', 'oak', '', 'lp'), CAST(p_partkey % 9 + 1 AS INT))"


@registered("""
WITH t AS (SELECT *, CASE p_partkey % 9 WHEN 0 THEN 'SS' WHEN 1 THEN 'SS' WHEN 2 THEN 'SP' WHEN 3 THEN 'DF' WHEN 4 THEN 'JL' WHEN 5 THEN 'HL' WHEN 8 THEN 'LP' END AS species FROM part),
f AS (SELECT *, CASE species WHEN 'SS' THEN 0.42e0 WHEN 'SP' THEN 0.43e0 WHEN 'DF' THEN 0.44e0 WHEN 'JL' THEN 0.4e0 WHEN 'HL' THEN 0.4e0 WHEN 'LP' THEN 0.41e0 ELSE 0.42e0 END AS form FROM t)
SELECT p_partkey, species, form, round(pi() * (p_size / 2e2) * (p_size / 2e2) * 2e1 * form, 8) AS volume_m3 FROM f""")
def species_form_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("label", F.expr(_LABELS))
    form = S.form_factor(F.col("label"))
    return rounded(part.select("p_partkey", S.species_code(F.col("label")).alias("species"), form.alias("form"), S.form_volume(F.col("p_size").cast("double"), F.lit(20.0), form).alias("volume_m3")), "volume_m3", digits=8)


@registered("""
WITH t AS (SELECT tree_id, tree_id * 2e0 AS x, tree_id * 3e0 AS y, height_m FROM {trees}), d AS (SELECT tree_id + 50 AS tree_id, height_m, dbh_cm, dbh_status, dbh_confidence FROM {trees})
SELECT tree_id, x, y, coalesce(t.height_m, d.height_m) AS height_m, dbh_cm, dbh_status, dbh_confidence FROM t FULL JOIN d USING (tree_id)""")
def tree_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = recipe(spark, sf_dir, "trees")
    tops = trees.selectExpr("tree_id", "tree_id * 2e0 AS x", "tree_id * 3e0 AS y", "height_m")
    return tariff.population(tops, trees.withColumn("tree_id", F.col("tree_id") + 50))


@registered("""
WITH f AS (SELECT tree_id, count(*) AS n, median(cx) AS cx, median(cy) AS cy, median(radius_m) AS r, avg(residual_m) AS cost FROM {slices} WHERE n_points >= 4 GROUP BY 1),
t AS (SELECT tree_id, CASE WHEN tree_id % 10 = 0 THEN 0 ELSE count(*) END AS n_points FROM {slices} GROUP BY 1)
SELECT tree_id, CASE WHEN n_points = 0 THEN 'empty_tree' WHEN coalesce(n, 0) < 3 THEN 'insufficient_seed_slices' ELSE 'seed_ok' END AS seed_status, CASE WHEN n >= 3 THEN cx END AS seed_cx, CASE WHEN n >= 3 THEN cy END AS seed_cy,
CASE WHEN n >= 3 THEN r END AS seed_r_m, coalesce(n, 0) AS seed_n_slices, CASE WHEN n >= 3 THEN round(cost, 6) END AS seed_mean_cost FROM t LEFT JOIN f USING (tree_id)""")
def seed_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = recipe(spark, sf_dir, "slices")
    trees = slices.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_points")).withColumn("n_points", F.when(F.col("tree_id") % 10 == 0, 0).otherwise(F.col("n_points")))
    fits = slices.where("n_points >= 4").select("tree_id", "cx", "cy", F.col("radius_m").alias("r"), F.col("residual_m").alias("cost"))
    return rounded(circles.seeds(trees, fits), "seed_mean_cost")


@registered("""
WITH s AS (SELECT tree_id, count(*) AS n_slices, max(cx) AS linearity, max(cy) * 10 AS verticality, max(n_points) * 5 AS n_points, min(cx) * 6 AS drift_mean, max(cx) * 8 AS drift_max FROM {slices} GROUP BY 1),
r AS (SELECT tree_id, n_points, n_slices, round(linearity * 10, 2) AS linearity, round(verticality, 2) AS verticality, round(drift_mean, 2) AS drift_mean, drift_max FROM s),
c AS (SELECT *, n_points < 30 AS few, n_points >= 30 AND linearity < 0.45e0 AS bent, n_points >= 30 AND verticality < 0.55e0 AS lean, n_slices < 3 AS short, n_slices >= 3 AND drift_mean > 0.25e0 AND drift_max > 0.5e0 AS drift FROM r)
SELECT tree_id, CAST(few AS INT) + CAST(bent AS INT) AS failures, concat_ws(';', CASE WHEN few THEN 'too_few_points' END, CASE WHEN bent THEN printf('linearity=%.2f', linearity) END, CASE WHEN lean THEN printf('verticality_warn=%.2f', verticality) END,
CASE WHEN short THEN 'too_few_slices_warn' END, CASE WHEN drift THEN printf('drift_warn=%.2f', drift_mean) END) AS fail_reasons,
CASE WHEN few OR bent THEN 'accepted_with_warning' ELSE 'good_candidate' END AS segment_status, CASE WHEN few OR bent THEN 'moderate' ELSE 'good' END AS segment_qc_tier FROM c""")
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = recipe(spark, sf_dir, "slices").groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_slices"), F.round(F.max("cx") * 10, 2).alias("linearity"), F.round(F.max("cy") * 10, 2).alias("verticality"), (F.max("n_points") * 5).alias("n_points"),
        F.round(F.min("cx") * 6, 2).alias("drift_mean"), (F.max("cx") * 8).alias("drift_max"),
    )
    return segments.segment_scores(each, reject_empty=False).select("tree_id", "failures", "fail_reasons", "segment_status", "segment_qc_tier")


@registered("""
WITH g AS (SELECT z - 5 AS z, classification = 2 AS ground FROM {points}), s AS (SELECT count(*) FILTER (ground) AS n_ground, avg(z) FILTER (ground) AS m, stddev_pop(z) FILTER (ground) AS d, min(z) FILTER (ground) AS ground_min, max(z) FILTER (ground) AS ground_max, min(z) AS z_min, max(z) AS z_max FROM g)
SELECT n_ground, round(m, 6) AS ground_mean, round(d, 6) AS ground_std, ground_min, ground_max, z_min, z_max, abs(m) > 1e-1 AS mean_is_off, d > 5e-1 AS spread_is_wide FROM s""")
def ground_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = recipe(spark, sf_dir, "points").withColumn("z", F.col("z") - 5)
    return rounded(terrain.ground_check(points, F.col("classification") == 2), "ground_mean", "ground_std")


@registered("""
SELECT s.tree_id, s.radius_m * 200 AS diameter_cm, o.o_totalprice / 1e4 AS dbh_cm, round(abs(s.radius_m * 200 - o.o_totalprice / 1e4), 6) AS delta_cm
FROM (SELECT l_orderkey AS tree_id, l_linenumber * 0.65e0 AS z_m, 2e-2 + l_extendedprice / 1e6 AS radius_m FROM lineitem) s JOIN orders o ON s.tree_id = o.o_orderkey WHERE abs(z_m - 1.3e0) < 1e-4""")
def profile_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS tree_id", "l_linenumber * 0.65D AS z_m", "(2e-2 + l_extendedprice / 1e6) * 200 AS diameter_cm")
    results = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS tree_id", "o_totalprice / 1e4 AS dbh_cm")
    return rounded(stems.profile_check(profile, results), "delta_cm")


_TILES = "n_nationkey AS tile_id, n_nationkey AS ordinal, (n_nationkey % 5) * 2e2 AS x0, (n_nationkey % 7) * 15e1 AS y0, (n_nationkey % 5) * 2e2 + 25e1 AS x1, (n_nationkey % 7) * 15e1 + 2e2 AS y1"


@registered(f"SELECT point_id, max(tile_id) AS tile_id FROM {{spots}} LEFT JOIN (SELECT {_TILES} FROM nation) t ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1")
def covering_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spark.sql(f"SELECT {_TILES} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return spatial.covering_tile(recipe(spark, sf_dir, "spots"), tiles, 200.0).select("point_id", "tile_id")


@registered("SELECT point_id, row_number() OVER (ORDER BY floor(y / 1e2), floor(x / 1e2), floor(y), floor(x), point_id) AS tree_id FROM {spots}")
def numbered_in_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = recipe(spark, sf_dir, "spots").selectExpr("point_id", "floor(y / 100) AS tj", "floor(x / 100) AS ti", "floor(y) AS row", "floor(x) AS col")
    return stats.numbered(spots, ["tj", "ti"], ["row", "col", "point_id"], "tree_id").select("point_id", "tree_id")


@registered("""
WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, (count(*) OVER () + 999) // 1000 AS step FROM lineitem)
SELECT l_orderkey, l_linenumber FROM n WHERE i % step = 0""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.floor(F.col("l_orderkey") / 1000).alias("block"))
    return stats.strided(lines, 1000, ["block"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@registered("""
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 14 DAY ELSE max(ts) - INTERVAL 60 MINUTE END AS window_start, TIMESTAMP '2024-06-01 00:00:00' AS window_end FROM events GROUP BY 1""")
def poll_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("last_at"))
    last = F.when(F.col("user_id") % 3 != 0, F.col("last_at"))
    return runs.select("user_id", feed.poll_window(last, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).alias("w")).select("user_id", "w.*")


@registered("SELECT s_suppkey AS site_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 NOT IN (1, 2)")
def leaf_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 4 == 1, "portfolio").when(F.col("s_suppkey") % 4 == 2, "estate").when(F.col("s_suppkey") % 4 == 3, "forest")
    sites = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("site_id"), kind.alias("kind"), F.when(F.col("s_suppkey") % 5 == 0, "2024-01-01").alias("deleted_at"))
    return feed.leaf_sites(sites).select("site_id")


@registered("""
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN a.n IS NULL AND b.n IS NULL THEN NULL ELSE coalesce(a.n, 0) + coalesce(b.n, 0) END AS size_bytes
FROM customer c LEFT JOIN (SELECT c_custkey + 5 AS k, c_nationkey * 10 AS n FROM customer) a ON a.k = c.c_custkey LEFT JOIN (SELECT c_custkey + 5 AS k, c_nationkey * 10 AS n FROM customer) b ON b.k = c.c_custkey * 2""")
def sizes_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    one = F.element_at(F.array(F.concat(F.lit("s3://store/raw/"), F.col("c_custkey")), F.concat(F.lit("/raw/"), F.col("c_custkey"))), (F.col("c_custkey") % 2 + 1).cast("int"))
    two = F.concat(F.lit("https://store.s3.amazonaws.com/raw/"), F.col("c_custkey") * 2)
    jobs = customer.select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(1)).cast("long").alias("size_bytes"), one.alias("raw_path"), two.alias("copc_path"))
    listing = customer.select(F.concat(F.lit("raw/"), F.col("c_custkey") + 5).alias("object_key"), (F.col("c_nationkey") * 10).cast("long").alias("bytes"))
    return feed.sizes_filled(jobs, listing, ["raw_path", "copc_path"]).select("job_id", "size_bytes")


@registered("""
WITH d AS (SELECT *, CASE WHEN point_id % 5 <> 0 AND point_id % 2 = 1 THEN 'green' WHEN point_id % 5 = 0 THEN 'grey' WHEN point_id % 3 = 0 THEN 'blue' ELSE 'red' END AS what FROM {spots})
SELECT point_id, CASE what WHEN 'grey' THEN 32767 WHEN 'red' THEN 65535 ELSE 0 END AS red, CASE what WHEN 'grey' THEN 32767 WHEN 'green' THEN 65535 ELSE 0 END AS green, CASE what WHEN 'grey' THEN 32767 WHEN 'blue' THEN 65535 ELSE 0 END AS blue FROM d""")
def diagnostic_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = recipe(spark, sf_dir, "spots")
    colour = S.diagnostic_colour(F.col("point_id") % 3, F.col("point_id") % 5 != 0, F.col("point_id") % 2)
    return spots.select("point_id", colour.alias("c")).select("point_id", *(F.col("c")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))


@registered("""
SELECT n_nationkey, epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_nationkey * 97)) // 3600000000 % 24 AS hour, CASE n_nationkey % 3 WHEN 0 THEN ['a', 'b', 'c'] ELSE ['a', 'b'] END AS machines, n_nationkey % 4 = 1 AS ours,
CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS kept, n_nationkey * 1e0 AS x_min, n_nationkey + 1e0 AS y_min, n_nationkey + 2e0 AS x_max, n_nationkey + 3e0 AS y_max FROM nation""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    time = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00+00:00").cast("timestamp")) + n * 97 * 60)
    machine = F.element_at(F.array(F.lit("c"), F.lit("a"), F.lit("")), (n % 3 + 1).cast("int"))
    address = F.element_at(F.array(F.lit("x@y"), F.lit("feed+7@y"), F.lit("feed+77@y"), F.lit(None).cast("string")), (n % 4 + 1).cast("int"))
    log = F.concat(F.lit("noise\n"), F.when(n % 2 == 0, F.format_string('{"kept": %d}', n.cast("long"))).otherwise("no record"), F.lit("\n"))
    d = n.cast("double")
    box = S.bounding_box(F.array(F.array(F.array(d, d + 3), F.array(d + 2, d + 1)), F.array(F.array(d + 1, d + 2))))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n, S.utc_hour(time).cast("long").alias("hour"), S.appended(F.array(F.lit("a"), F.lit("b")), machine).alias("machines"), S.addressed_to(F.array(F.lit("z@y"), address), "feed+7@").alias("ours"),
        S.last_line_json(log, "kept long")["kept"].alias("kept"), box.alias("box"),
    ).select("n_nationkey", "hour", "machines", "ours", "kept", "box.*")

"""Point-cloud gridding, focal statistics, hexagons and raster derivatives on sparse long-form grids (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.functions import scalar as S
from canopyq.operators.graph import connected_components


def celled(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Points with the row and col of their cell."""
    return points.withColumns({"row": S.cell_of(F.col("y"), size, y0), "col": S.cell_of(F.col("x"), size, x0)})


def canopy_height(points: DataFrame, size: float = 0.5) -> DataFrame:
    """Highest point of each cell as a float; cells whose highest is not above 0 are nodata and left out."""
    return celled(points, size).groupBy("row", "col").agg(F.max(F.col("z").cast("float")).alias("value")).where("value > 0")


def ground_median(points: DataFrame, size: float = 0.5) -> DataFrame:
    """Independent medians of x, y and z of each cell."""
    return celled(points, size).groupBy("row", "col").agg(*(F.median(c).alias(n) for c, n in (("x", "x"), ("y", "y"), ("z", "ground_z"))))


def cell_profile(points: DataFrame, size: float, ground: Column) -> DataFrame:
    """Lowest, highest and number of points of each cell, and the lowest among ground points."""
    return celled(points, size).groupBy("row", "col").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count(F.lit(1)).alias("n"), F.min(F.when(ground, F.col("z"))).alias("ground_min"))


def raster_summary(grid: DataFrame, value: str = "value", steep: float = 30.0) -> DataFrame:
    v = F.col(value)
    return grid.agg(F.count(v).alias("n_cells"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.avg(F.when(v > steep, 100.0).otherwise(0.0)).alias("percent_above"))


def hex_density(points: DataFrame, area: float = 25.0) -> DataFrame:
    """Points of each hexagon, their number per hectare and its share of the densest hexagon's."""
    q, r = S.hex_cell(F.col("x"), F.col("y"), area)
    cells = points.select(q.alias("hex_q"), r.alias("hex_r")).groupBy("hex_q", "hex_r").agg(F.count(F.lit(1)).alias("n"))
    top = cells.agg(F.max("n").alias("_top"))
    return cells.crossJoin(F.broadcast(top)).select("hex_q", "hex_r", "n", (F.col("n") / (area / 10000.0)).alias("per_ha"), (F.col("n") / F.col("_top")).alias("share"))  # one row


def clusters(points: DataFrame, size: float = 100.0, density: float = 0.05) -> DataFrame:
    """8-connected clusters of cells with enough points: number of points and cells, and bounds; the largest first in rank.

    A cell's neighbours are reached by an equi join on shifted indices. Only cells, not points, enter the component search.
    """
    least = max(1, int(density * size * size))
    cells = celled(points, size).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    shift = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    node = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))
    ends = cells.select("row", "col", F.explode(shift).alias("s")).select(node(F.col("row"), F.col("col")).alias("src"), node(F.col("row") + F.col("s.a"), F.col("col") + F.col("s.b")).alias("dst"))
    known = cells.select(node(F.col("row"), F.col("col")).alias("dst"))
    parts = connected_components(ends.join(known, "dst")).select(F.col("node.row").alias("row"), F.col("node.col").alias("col"), "component")
    found = cells.join(parts, ["row", "col"]).groupBy("component").agg(
        F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_cells"), (F.min("col") * size).alias("x_min"), (F.min("row") * size).alias("y_min"), ((F.max("col") + 1) * size).alias("x_max"), ((F.max("row") + 1) * size).alias("y_max")
    )
    return found.select("n_points", "n_cells", "x_min", "y_min", "x_max", "y_max")


def top_clusters(found: DataFrame, k: int = 6) -> DataFrame:
    """The largest clusters, ranked; the one after the first is suspicious above a quarter of its points."""
    order = [F.desc("n_points"), F.asc("x_min"), F.asc("y_min")]
    top = found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    return top.withColumn("suspicious", (F.col("rank") == 2) & (F.col("n_points") > F.lag("n_points").over(Window.orderBy("rank")) * 0.25))


def _neighbours(grid: DataFrame, half: int) -> DataFrame:
    """Each cell's value sent to all cells whose window of half-width ``half`` holds it."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    sent = grid.select("row", "col", "value", F.explode(steps).alias("a")).select("row", "col", "value", "a", F.explode(steps).alias("b"))
    return sent.select((F.col("row") + F.col("a")).alias("row"), (F.col("col") + F.col("b")).alias("col"), F.col("value").alias("near"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))


def focal(grid: DataFrame, half: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the present cells of each cell's square window (column ``near``); one shuffle, no join of big tables twice."""
    near = _neighbours(grid, half).groupBy("row", "col").agg(*(c.alias(n) for n, c in aggregates.items()))
    return grid.join(near, ["row", "col"])


def local_maxima(grid: DataFrame, half: int = 1, least: float = 0.0) -> DataFrame:
    """Cells that no cell of their window exceeds."""
    return focal(grid, half, top=F.max("near")).where((F.col("value") == F.col("top")) & (F.col("value") >= least)).select("row", "col", "value")


def slope_aspect(grid: DataFrame, size: float) -> DataFrame:
    """Slope and aspect by Horn's 3 x 3 weights; only cells with all eight neighbours."""
    a, b, v = F.col("a"), F.col("b"), F.col("near")
    wx = F.sum(b * (F.lit(2) - F.abs(a)) * F.when(b != 0, v).otherwise(0.0))
    wy = F.sum(a * (F.lit(2) - F.abs(b)) * F.when(a != 0, v).otherwise(0.0))
    found = focal(grid, 1, gx=wx / (8.0 * size), gy=wy / (8.0 * size), cells=F.count("near")).where("cells = 9")
    return found.select("row", "col", S.slope_degrees(F.col("gx"), F.col("gy")).alias("slope"), S.aspect_degrees(F.col("gx"), F.col("gy")).alias("aspect"), "gx", "gy")


def hillshade(derivatives: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Brightness 0..255 of cells with slope and aspect."""
    zenith, slope = F.radians(F.lit(90.0 - altitude)), F.radians("slope")
    light = F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(F.radians(F.lit(azimuth) - F.col("aspect")))
    return derivatives.select("row", "col", (S.clamp(light, 0.0, 1.0) * 255.0).alias("shade"))


def d8(grid: DataFrame, size: float = 1.0) -> DataFrame:
    """Direction (0..7 clockwise from north-west in reading order) of the strictly steepest descent; the first of equal ones, null in a pit."""
    order = F.when(F.col("a") == -1, F.col("b") + 1).when(F.col("a") == 0, F.when(F.col("b") == -1, 3).otherwise(4)).otherwise(F.col("b") + 6)
    away = (F.abs("a") + F.abs("b")) > 0
    run = F.when(F.abs("a") + F.abs("b") == 2, size * 2.0**0.5).otherwise(size)
    pairs = _neighbours(grid, 1).where(away).withColumn("order", order).join(grid, ["row", "col"])
    drops = pairs.withColumn("drop", (F.col("value") - F.col("near")) / run).where("drop > 0")
    best = drops.groupBy("row", "col").agg(F.max(F.struct("drop", (-F.col("order")).alias("o"), "a", "b")).alias("s"))
    found = best.select("row", "col", (-F.col("s.o")).cast("int").alias("direction"), (F.col("row") + F.col("s.a")).cast("int").alias("to_row"), (F.col("col") + F.col("s.b")).cast("int").alias("to_col"))
    return grid.select("row", "col").join(found, ["row", "col"], "left")


def bilinear(points: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """Grid value at points between cell centres: bilinear where all four are present, else the nearest present; null outside."""
    fx, fy = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    placed = points.withColumns({"_c": F.floor(fx).cast("int"), "_r": F.floor(fy).cast("int")}).withColumns({"_u": fx - F.col("_c"), "_v": fy - F.col("_r")})
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    four = placed.withColumn("_k", F.explode(corner)).withColumns({"row": F.col("_r") + F.col("_k.a"), "col": F.col("_c") + F.col("_k.b")})
    valued = four.join(grid, ["row", "col"])
    wu, wv = F.when(F.col("_k.b") == 1, F.col("_u")).otherwise(1 - F.col("_u")), F.when(F.col("_k.a") == 1, F.col("_v")).otherwise(1 - F.col("_v"))
    far = F.pow(1 - wu, F.lit(2)) + F.pow(1 - wv, F.lit(2))
    found = valued.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("value") * wu * wv).alias("_b"), F.min_by("value", F.struct(far, "row", "col")).alias("_near"))
    sampled = found.select("point_id", F.when(F.col("_n") == 4, F.col("_b")).otherwise(F.col("_near")).alias("sample"))
    return points.join(sampled, "point_id", "left")


def tile_rows(points: DataFrame, tile: float, buffer: float) -> DataFrame:
    """Each point once for each tile whose buffered square holds it; ``is_core`` in the half-open tile that owns it."""
    lo = lambda c: F.floor((F.col(c) - buffer) / tile)
    hi = lambda c: F.floor((F.col(c) + buffer) / tile)
    out = points.withColumn("tile_i", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("tile_j", F.explode(F.sequence(lo("y"), hi("y"))))
    return out.withColumn("is_core", (F.col("tile_i") == F.floor(F.col("x") / tile)) & (F.col("tile_j") == F.floor(F.col("y") / tile)))


def tile_size(n_points: int, area: float, target: int = 12_000_000, least: float = 25.0, most: float = 500.0) -> float:
    """Side of a square tile with about ``target`` points."""
    if n_points <= 0 or area <= 0:
        return most
    return min(most, max(least, (target / (n_points / area)) ** 0.5))

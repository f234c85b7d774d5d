"""Ground filtering and surface filling on sparse grids, and summaries of drainage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.operators.flood import priority_flood  # noqa: F401
from canopyq.operators.flow import flow_accumulation  # noqa: F401
from canopyq.operators.grid import celled, focal
from canopyq.operators.spatial import nearest
from canopyq.plans.storage import stored


def ground_points(points: DataFrame, size: float = 0.5, windows: tuple[int, ...] = (1, 2, 4), slope: float = 0.3, first: float = 0.3, most: float = 2.0) -> DataFrame:
    """Adds ``is_ground`` by a progressive morphological filter on the lowest point of each cell.

    Openings with growing windows lower the surface; a cell that drops by more than the window's height limit isn't ground. Published stand-in for cloth simulation.
    """
    surface = celled(points, size).groupBy("row", "col").agg(F.min("z").alias("value"))
    state = surface.withColumn("ground", F.lit(True))
    for half in windows:
        low = focal(state.select("row", "col", "value"), half, e=F.min("near")).select("row", "col", F.col("e").alias("value"))
        opened = focal(low, half, o=F.max("near")).select("row", "col", "o")
        limit = min(most, first + slope * 2 * half * size)
        j = state.join(opened, ["row", "col"])
        state = stored(j.select("row", "col", F.col("o").alias("value"), (F.col("ground") & (F.col("value") - F.col("o") <= limit)).alias("ground")), "opened")
    j = celled(points, size).join(state.withColumnRenamed("value", "_low"), ["row", "col"])
    return j.withColumn("is_ground", F.col("ground") & (F.col("z") - F.col("_low") <= first)).drop("row", "col", "ground", "_low")


def height_above(points: DataFrame, ground: DataFrame) -> DataFrame:
    """Points with z above the nearest ground node (ground_id, x, y, ground_z)."""
    near = nearest(points, ground)
    return points.join(near, "point_id").join(ground.select("ground_id", "ground_z"), "ground_id").withColumn("height", F.col("z") - F.col("ground_z")).select(*points.columns, "height", "distance")


def filled_surface(grid: DataFrame, half: int = 3, power: float = 2.0) -> DataFrame:
    """The grid with holes inside its neighbourhood filled by inverse distance over cells within ``half``; ``filled`` marks them."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    sent = grid.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).where("a <> 0 or b <> 0")
    weight = F.pow((F.col("a") * F.col("a") + F.col("b") * F.col("b")).cast("double"), F.lit(-power / 2))
    guess = sent.groupBy((F.col("row") + F.col("a")).alias("row"), (F.col("col") + F.col("b")).alias("col")).agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("_g"), F.max("a").alias("_a1"), F.min("a").alias("_a0"), F.max("b").alias("_b1"), F.min("b").alias("_b0"))
    enclosed = (F.col("_a0") < 0) & (F.col("_a1") > 0) & (F.col("_b0") < 0) & (F.col("_b1") > 0)
    holes = guess.where(enclosed).join(grid.select("row", "col"), ["row", "col"], "left_anti").select("row", "col", F.col("_g").alias("value"), F.lit(True).alias("filled"))
    return grid.select("row", "col", "value").withColumn("filled", F.lit(False)).unionByName(holes)


def drainage_summary(flow: DataFrame, size: float, least_area: float = 750.0) -> DataFrame:
    area = F.col("cells") * (size * size)
    stream = F.count_if(area >= least_area)
    return flow.agg(stream.alias("stream_cells"), (stream * size).alias("stream_length_m"), (F.max(area) / 10000.0).alias("largest_ha"), F.max(F.log10(F.greatest(area, F.lit(1.0)))).alias("log_area_max"))


def ground_check(points: DataFrame, ground: Column, height: str = "z", most_mean: float = 0.1, most_spread: float = 0.5) -> DataFrame:
    """One row on the heights of ground points, which should be near 0: mean, deviation and range, the range of all points, and warnings."""
    g = F.when(ground, F.col(height))
    out = points.agg(
        F.count(g).alias("n_ground"), F.avg(g).alias("ground_mean"), F.stddev_pop(g).alias("ground_std"), F.min(g).alias("ground_min"), F.max(g).alias("ground_max"), F.min(height).alias("z_min"), F.max(height).alias("z_max")
    )
    return out.withColumns({"mean_is_off": F.coalesce(F.abs("ground_mean") > most_mean, F.lit(False)), "spread_is_wide": F.coalesce(F.col("ground_std") > most_spread, F.lit(False))})

"""Stem measurement along height: slices, taper models, profiles, diameters at breast height, volumes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.functions import scalar as S
from canopyq.operators.stats import effective_count, weighted_line

BREAST = 1.3


def slice_score(df: DataFrame) -> DataFrame:
    """Score and class of slices (coverage_deg, residual_m, radius_m, interior_ratio, n_points): ring_good, arc_usable or weak."""
    score = S.linear_score(F.col("coverage_deg"), 40.0, 180.0) * 0.50 + S.linear_score(F.col("residual_m"), 0.070, 0.010) * 0.35 + S.linear_score(F.col("radius_m"), 0.25, 0.03) * 0.15
    rejected = (F.col("interior_ratio") > 0.30) | (F.col("radius_m") >= 0.25)
    kind = F.when(rejected, "weak").when((score >= 0.65) & (F.col("n_points") >= 8), "ring_good").when((score >= 0.25) & (F.col("n_points") >= 6), "arc_usable").otherwise("weak")
    return df.withColumn("slice_score", F.when(rejected, 0.0).otherwise(score)).withColumn("slice_class", kind)


def slice_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """Weights of slices for radius and centre fits: class, coverage, residual, score, size against the median, height in the group."""
    group = Window.partitionBy(*by)
    base = F.when(F.col("slice_class") == "ring_good", 8.0).otherwise(0.2) * S.clamp(F.col("coverage_deg") / 180.0, 0.25, 1.0)
    base = base * F.greatest(F.lit(0.25), F.lit(1.0) - F.least(F.col("residual_m") / 0.08, F.lit(1.0))) * S.clamp(F.col("slice_score"), 0.1, 1.0)
    z = F.coalesce(F.try_divide(F.col("z_mid") - F.min("z_mid").over(group), F.max("z_mid").over(group) - F.min("z_mid").over(group)), F.lit(0.0))
    size = S.clamp(F.pow(F.try_divide(F.median("radius_m").over(group), F.col("radius_m")), F.lit(1.5)), 0.5, 2.5)
    radius = base * size * S.clamp(F.lit(1.6) - z * 0.9, 0.7, 1.6)
    return df.withColumns({"weight_radius": radius, "weight_centre": base * S.clamp(F.lit(1.25) - z * 0.35, 0.9, 1.25)})


def taper_models(slices: DataFrame, by: list[str], least: int = 3, limit: float = 0.010, shrink: float = 0.70) -> DataFrame:
    """Linear models of centre and radius over height for groups of at least ``least`` slices, as coefficient columns.

    Centre lines weigh residuals by the weight, so squares enter the sums; the radius line has its slope clipped and shrunk about the weighted means.
    """
    w2, wr = F.col("weight_centre") * F.col("weight_centre"), F.col("weight_radius")
    wr2 = wr * wr
    cx1, cx0 = weighted_line(F.col("cx"), F.col("z_mid"), w2)
    cy1, cy0 = weighted_line(F.col("cy"), F.col("z_mid"), w2)
    r1, _ = weighted_line(F.col("radius_m"), F.col("z_mid"), wr2)
    sums = slices.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_slices_model"), cx0.alias("cx_coef_0"), cx1.alias("cx_coef_1"), cy0.alias("cy_coef_0"), cy1.alias("cy_coef_1"), r1.alias("_r1"),
        F.try_divide(F.sum(wr * F.col("z_mid")), F.sum(wr)).alias("_zm"), F.try_divide(F.sum(wr * F.col("radius_m")), F.sum(wr)).alias("_rm"),
        F.min("z_mid").alias("z_min_model"), F.max("z_mid").alias("z_max_model"), effective_count(wr).alias("eff_dof"),
    ).where(F.col("n_slices_model") >= least)
    slope = S.clamp(F.coalesce("_r1", F.lit(0.0)), -limit, limit) * shrink
    return sums.withColumn("r_coef_1", slope).withColumn("r_coef_0", F.col("_rm") - F.col("r_coef_1") * F.col("_zm")).drop("_r1", "_zm", "_rm")


def model_rmse(slices: DataFrame, models: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square residuals of centre and radius of the models."""
    j = slices.join(models, by)
    line = lambda n: F.col(f"{n}_coef_0") + F.coalesce(F.col(f"{n}_coef_1"), F.lit(0.0)) * F.col("z_mid")
    dx, dy, dr = F.col("cx") - line("cx"), F.col("cy") - line("cy"), F.col("radius_m") - line("r")
    return j.groupBy(*by).agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("centre_rmse"), F.sqrt(F.avg(dr * dr)).alias("radius_rmse"))


def bracket(slices: DataFrame, by: list[str], at: Column, value: str = "radius_m", z: str = "z_mid", tolerance: float = 0.35) -> DataFrame:
    """Nearest slices at or below and at or above a height within a tolerance, the nearest of all, and the value interpolated between."""
    v, h = F.col(value), F.col(z)
    below, above = (h <= at) & (at - h <= tolerance), (h >= at) & (h - at <= tolerance)
    key = F.struct(F.abs(h - at), h, v)
    found = slices.groupBy(*by).agg(
        F.max(F.when(below, F.struct(h.alias("z"), v.alias("v")))).alias("lo"), F.min(F.when(above, F.struct(h.alias("z"), v.alias("v")))).alias("hi"),
        F.min(key).alias("_near"), F.count(F.lit(1)).alias("n_slices"),
    )
    found = found.select(*by, "n_slices", F.col("lo.z").alias("z_lo"), F.col("lo.v").alias("v_lo"), F.col("hi.z").alias("z_hi"), F.col("hi.v").alias("v_hi"), F.col("_near.col1").alias("gap"), F.col(f"_near.{value}").alias("v_near"))
    mid = F.when(F.col("z_hi") > F.col("z_lo"), F.col("v_lo") + F.try_divide((F.col("v_hi") - F.col("v_lo")) * (at - F.col("z_lo")), F.col("z_hi") - F.col("z_lo"))).otherwise(F.col("v_lo"))
    return found.withColumn("interpolated", F.when(F.col("z_lo").isNotNull() & F.col("z_hi").isNotNull(), mid))


def breast_diameter(slices: DataFrame, models: DataFrame, by: list[str], tolerance: float = 0.25, reach: float = 1.5) -> DataFrame:
    """Diameter at breast height: interpolated, else the nearest slice within ``tolerance``, else the model up to ``reach`` from its slices, else null."""
    at = F.lit(BREAST)
    b = bracket(slices, by, at, tolerance=tolerance)
    j = b.join(models, by, "left")
    gap = F.greatest(F.col("z_min_model") - at, at - F.col("z_max_model"), F.lit(0.0))
    model = F.greatest(F.col("r_coef_0") + F.col("r_coef_1") * at, F.lit(0.0))
    choose = lambda a, n, m: F.when(F.col("interpolated").isNotNull(), a).when(F.col("gap") <= tolerance, n).when(gap <= reach, m)
    return j.select(
        *by, "n_slices", (choose(F.col("interpolated"), F.col("v_near"), model) * 200.0).alias("dbh_cm"),
        F.coalesce(choose(F.lit("interpolated"), F.lit("nearest"), F.lit("model_taper")), F.lit("none")).alias("dbh_source"), choose(F.lit(0.0), F.col("gap"), gap).alias("dbh_gap_m"),
    )


def near_support(slices: DataFrame, by: list[str], at: Column, reach: float = 0.40, **values: str) -> DataFrame:
    """Means over slices within ``reach`` of a height, or over all slices if none is."""
    close = F.abs(F.col("z_mid") - at) <= reach
    return slices.groupBy(*by).agg(*(F.coalesce(F.avg(F.when(close, F.col(c))), F.avg(c)).alias(n) for n, c in values.items()))


def dbh_confidence(df: DataFrame) -> DataFrame:
    """Confidence from mean coverage, residual, radius deviation, gap of a model estimate and coverage near breast height."""
    value = S.clamp(F.col("coverage_mean") / 180.0, 0.0, 1.0) * F.greatest(F.lit(0.0), 1.0 - F.least(F.col("residual_mean") / 0.08, F.lit(1.0))) * F.greatest(F.lit(0.0), 1.0 - F.least(F.col("radius_sd_cm") / 10.0, F.lit(1.0)))
    value = value * F.when(F.col("dbh_source") == "model_taper", 1.0 - F.least(F.col("dbh_gap_m") / 1.5, F.lit(1.0)) * 0.40).otherwise(1.0)
    return df.withColumn("dbh_confidence", value * F.greatest(F.lit(0.5), F.least(F.col("coverage_near") / 180.0, F.lit(1.0))))


def dbh_status(df: DataFrame) -> DataFrame:
    """Status of a tree from its slices, estimate and coverage."""
    status = (
        F.when(F.col("n_slices") < 3, "insufficient_slices").when(F.col("dbh_cm").isNull(), "dbh_unsupported").when(F.col("n_ring_good") >= 3, "good")
        .when(F.col("n_ring_good") >= 1, "limited_support").when(F.col("n_arc_usable") >= 3, "partial_arc").otherwise("no_consensus")
    )
    return df.withColumn("status", status)


def profile(models: DataFrame, slices: DataFrame, by: list[str], low: float = 0.5, high: float = 5.0, step: float = 0.2, scale: float = 1.0) -> DataFrame:
    """Model diameters at fixed heights and breast height, with the support that slices give: direct, interpolated or model_only.

    Heights are exploded per model; each meets its own tree's slices only, a bounded group.
    """
    n = int(round((high - low) / step))
    heights = F.array_sort(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(i * step + low, 2)), F.array(F.lit(BREAST)))))
    asked = models.select(*by, "r_coef_0", "r_coef_1", F.explode(heights).alias("z_m"))
    radius = F.greatest(F.col("r_coef_0") + F.col("r_coef_1") * F.col("z_m"), F.lit(0.035)) * scale
    gap = F.abs(F.col("z_mid") - F.col("z_m"))
    j = asked.join(slices.select(*by, "z_mid"), by, "left").groupBy(*by, "z_m", "r_coef_0", "r_coef_1").agg(
        F.min(gap).alias("support_gap_m"), F.min(F.when(F.col("z_mid") <= F.col("z_m"), gap)).alias("_lo"), F.min(F.when(F.col("z_mid") >= F.col("z_m"), gap)).alias("_hi")
    )
    source = F.when(F.col("support_gap_m") <= 0.12, "direct").when((F.col("_lo") <= 0.35) & (F.col("_hi") <= 0.35), "interpolated").otherwise("model_only")
    return j.select(*by, "z_m", radius.alias("radius_m"), (radius * 200.0).alias("diameter_cm"), source.alias("diameter_source"), "support_gap_m")


def profile_confidence(df: DataFrame) -> DataFrame:
    """Confidence of profile rows from support, near coverage, residual and score, and model errors."""
    base = S.clamp(F.col("coverage_near") / 180.0, 0.0, 1.0) * F.greatest(F.lit(0.0), 1.0 - F.col("residual_near") / 0.08) * F.greatest(F.lit(0.1), F.col("score_near"))
    gap = F.coalesce("support_gap_m", F.lit(1.0))
    support = (
        F.when(F.col("diameter_source") == "direct", F.greatest(F.lit(0.75), 1.0 - gap / 0.12))
        .when(F.col("diameter_source") == "interpolated", F.greatest(F.lit(0.5), 1.0 - gap / 0.35) * 0.90)
        .otherwise(F.greatest(F.lit(0.6), 1.0 - F.least(F.col("centre_rmse") / 0.2, F.lit(0.4))) * F.greatest(F.lit(0.6), 1.0 - F.least(F.col("radius_rmse") / 0.08, F.lit(0.4))) * 0.75)
    )
    return df.withColumn("profile_confidence", base * support)


def smalian(profiles: DataFrame, by: list[str], z: str = "z_m", radius: str = "radius_m", top_radius: float = 0.035, butt: float = 1.12, butt_from: float = 0.3) -> DataFrame:
    """Merchantable volume of each stem: Smalian sections up to the top radius, the last one cut where the radius is reached.

    A butt section is put below stems whose first point is above ``butt_from``. Stems of fewer than two points have none. Points of a stem are ordered by
    height and radius; one window per stem, a bounded group.
    """
    order = Window.partitionBy(*by).orderBy(z, radius)
    first = profiles.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(z, radius)).alias("_f")).where("_n >= 2")
    base = first.where(F.col(f"_f.{z}") > butt_from).select(*by, F.lit(0.0).alias(z), (F.col(f"_f.{radius}") * (butt / 2.0 + 0.5)).alias(radius))
    points = profiles.join(first.select(*by), by, "left_semi").select(*by, F.col(z).cast("double").alias(z), radius).unionByName(base)
    pairs = points.withColumns({"_z1": F.lead(z).over(order), "_r1": F.lead(radius).over(order)}).where("_z1 is not null")
    crossed = (F.col("_r1") <= top_radius) & (F.col(radius) >= top_radius) & (F.col(radius) != F.col("_r1"))
    past = Window.partitionBy(*by).orderBy(z, radius).rowsBetween(Window.unboundedPreceding, -1)
    walked = pairs.withColumn("_x", crossed.cast("int")).withColumn("_stop", F.coalesce(F.sum("_x").over(past), F.lit(0))).where("_stop = 0")
    share = F.when(F.col("_x") == 1, F.try_divide(F.col(radius) - top_radius, F.col(radius) - F.col("_r1"))).otherwise(1.0)
    r_end = F.when(F.col("_x") == 1, top_radius).otherwise(F.col("_r1"))
    section = (F.col(radius) * F.col(radius) * math.pi + r_end * r_end * math.pi) / 2.0 * ((F.col("_z1") - F.col(z)) * share)
    return walked.groupBy(*by).agg(F.sum(section).alias("volume_m3"), F.count(F.lit(1)).alias("n_sections"))


def centroid_drift(points: DataFrame, by: list[str], step: float = 0.5, least: int = 5, from_lowest: bool = False, copies: str | None = None) -> DataFrame:
    """Mean and largest move of the centroid between consecutive height slices with enough points.

    Slices begin at multiples of ``step``, or with ``from_lowest`` at the group's lowest point and below its highest. ``copies`` is how many points a row stands for.
    """
    place, rows = F.floor(F.col("z") / step), points
    if from_lowest:
        rows = points.join(points.groupBy(*by).agg(F.min("z").alias("_z0"), F.max("z").alias("_z1")), by)
        place = F.floor((F.col("z") - F.col("_z0")) / step)
        rows = rows.where(place * step + F.col("_z0") < F.col("_z1"))
    number = F.sum(copies) if copies else F.count(F.lit(1))
    middle = {c: F.sum(F.col(copies) * F.col(c)) / number if copies else F.avg(c) for c in "xy"}
    slices = rows.groupBy(*by, place.alias("_s")).agg(number.alias("_n"), *(m.alias(f"_{c}") for c, m in middle.items())).where(F.col("_n") >= least)
    order = Window.partitionBy(*by).orderBy("_s")
    dx, dy = F.col("_x") - F.lag("_x").over(order), F.col("_y") - F.lag("_y").over(order)
    moved = slices.withColumn("_d", F.sqrt(dx * dx + dy * dy))
    return moved.groupBy(*by).agg(F.count(F.lit(1)).alias("n_slices"), F.avg("_d").alias("drift_mean"), F.max("_d").alias("drift_max"))


def angular_coverage(points: DataFrame, by: list[str], cx: str, cy: str, bin_deg: float = 10.0) -> DataFrame:
    """Degrees of the circle whose bins hold a point."""
    angle = S.bearing(F.col("y") - F.col(cy), F.col("x") - F.col(cx))
    return points.groupBy(*by).agg((F.count_distinct(F.floor(angle / bin_deg)) * bin_deg).alias("coverage_deg"), F.count(F.lit(1)).alias("n_points"))


def log_positions(logs: DataFrame, by: list[str], order: str, start: str, length: str) -> DataFrame:
    """Start and end of each log: a given start restarts the run, missing ones follow the log before."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = logs.withColumn("_run", F.count(start).over(so_far))
    within = Window.partitionBy(*by, "_run").orderBy(order)
    begin = F.coalesce(F.first(start).over(within), F.lit(0)) + F.coalesce(F.sum(length).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("start_at", begin).withColumn("end_at", F.col("start_at") + F.col(length)).drop("_run")


def profile_check(profile: DataFrame, results: DataFrame, height: float = 1.3) -> DataFrame:
    """Trees whose profile has a diameter at breast height and whose results have one too, and how far the two are apart."""
    at = profile.where(F.abs(F.col("z_m") - height) < 1e-4).select("tree_id", "diameter_cm")
    both = at.join(results.where("dbh_cm is not null").select("tree_id", "dbh_cm"), "tree_id").where("diameter_cm is not null")
    return both.withColumn("delta_cm", F.abs(F.col("diameter_cm") - F.col("dbh_cm")))

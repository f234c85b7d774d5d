"""Stand and compartment volumes by the tariff method, wholly relational."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.functions import scalar as S
from canopyq.operators.spatial import first_polygon
from canopyq.operators.stats import line_fit, robust_mean


@dataclass(frozen=True)
class TariffRules:
    """Limits of the method: slenderness of sample trees, least diameter, confidence, deviations, samples of a compartment."""

    slenderness: float = 60.0
    least_dbh: float = 7.0
    least_confidence: float = 0.40
    deviations: float = 2.5
    least_samples: int = 4
    form: float = 0.42


def tree_tariffs(trees: DataFrame, profiles: DataFrame | None, rules: TariffRules = TariffRules()) -> DataFrame:
    """Volume of every tree: (tree_id, compartment, dbh_cm, height_m, tier, tariff, volume_m3, volume_height_m3).

    ``trees`` has tree_id, compartment (null outside all), height_m, dbh_cm, dbh_status and dbh_confidence, each may be null;
    ``profiles`` has tree_id and volume_m3 of measured stems. A column ``form`` of ``trees`` gives form factors by tree, those of ``rules`` fill its nulls. The stand's figures are one-row aggregates joined back; nothing else shuffles but compartments.
    """
    slender = F.try_divide(F.col("height_m") * 100.0, F.col("dbh_cm"))
    measured = F.col("dbh_cm") > 0
    base = trees.withColumns({"_ba": S.basal_area(F.col("dbh_cm")), "_slender": slender, "_measured": F.coalesce(measured, F.lit(False))})
    good = F.col("_measured") & (F.coalesce("dbh_status", F.lit("")) != "dbh_unsupported") & (F.coalesce("dbh_confidence", F.lit(1.0)) >= rules.least_confidence) & (F.coalesce("_slender", F.lit(1e9)) >= rules.slenderness)
    joined = base.join(profiles.select("tree_id", F.col("volume_m3").alias("_profile")), "tree_id", "left") if profiles is not None else base.withColumn("_profile", F.lit(None).cast("double"))
    form = F.coalesce(F.col("form"), F.lit(rules.form)) if "form" in trees.columns else F.lit(rules.form)
    volume = F.when(F.col("_profile") > 0, F.col("_profile")).otherwise(S.form_volume(F.col("dbh_cm"), F.col("height_m"), form))
    sample = joined.where(good).withColumn("_t", S.tariff_number(volume, F.col("_ba"))).where("_t > 0 and not isnan(_t)")
    sample = sample.withColumn("_h", S.height_tariff(F.col("height_m"), F.col("dbh_cm"))).withColumn("_h", F.when(F.col("_h") > 0, F.col("_h")))
    stand = robust_mean(sample, "_t", [], rules.deviations).select(F.col("robust_mean").alias("_stand"))
    by_height = robust_mean(sample, "_h", [], rules.deviations).select(F.col("robust_mean").alias("_stand_h"))
    fit = base.where("_measured and height_m is not null").agg(*line_fit("dbh_cm", "height_m")).select(F.col("slope").alias("_a"), F.col("intercept").alias("_b"))
    mean = base.where("_measured").agg(F.avg("dbh_cm").alias("_mean"))
    figures = stand.crossJoin(by_height).crossJoin(fit).crossJoin(mean)  # one row each
    parts = robust_mean(sample.where("compartment is not null"), "_t", ["compartment"], rules.deviations).where(F.col("n") >= rules.least_samples).select("compartment", F.col("robust_mean").alias("_own"))
    all_trees = base.crossJoin(F.broadcast(figures)).join(parts, "compartment", "left")
    line = F.col("_a") * F.col("height_m") + F.col("_b")
    from_height = F.when(line > 0, line).otherwise(F.col("_mean"))
    has_height, weak = F.col("height_m").isNotNull(), F.col("dbh_status") == "dbh_unsupported"
    tier = (
        F.when(F.col("_measured") & has_height & (F.col("_slender") < rules.slenderness), "hd_model").when(F.col("_measured") & weak, "circle_fit_weak").when(F.col("_measured"), "circle_fit_filtered")
        .when(has_height, "hd_model").otherwise("stand_mean")
    )
    dbh = F.when(tier == "hd_model", from_height).when(tier == "stand_mean", F.col("_mean")).otherwise(F.col("dbh_cm"))
    done = all_trees.withColumn("tier", tier).withColumn("_dbh", dbh).withColumn("tariff", F.coalesce("_own", "_stand"))
    area = S.basal_area(F.col("_dbh"))
    kept = lambda v: F.when((F.col("_dbh") > 0) & (F.col("_dbh") < rules.least_dbh), 0.0).otherwise(F.greatest(F.lit(0.0), v))
    return done.select(
        "tree_id", "compartment", "height_m", F.col("dbh_cm").alias("measured_dbh_cm"), F.col("_dbh").alias("dbh_cm"), "tier", "tariff",
        kept(S.tariff_volume(F.col("tariff"), area)).alias("volume_m3"), kept(S.tariff_volume(F.col("_stand_h"), area)).alias("volume_height_m3"),
        (F.col("_own").isNotNull()).alias("own_tariff"),
    )


def population(tops: DataFrame, diameters: DataFrame) -> DataFrame:
    """Every tree that is a tree top or has a diameter, once: the top's place and height, the other's height where the top has none, and diameters.

    ``tops`` has tree_id, x, y and height_m; ``diameters`` tree_id, height_m, dbh_cm, dbh_status and dbh_confidence.
    """
    measured = diameters.select("tree_id", F.col("height_m").alias("_height"), "dbh_cm", "dbh_status", "dbh_confidence")
    return tops.select("tree_id", "x", "y", "height_m").join(measured, "tree_id", "full_outer").select(
        "tree_id", "x", "y", F.coalesce("height_m", "_height").alias("height_m"), "dbh_cm", "dbh_status", "dbh_confidence"
    )


def volumes_of_site(tops: DataFrame, diameters: DataFrame, profiles: DataFrame | None, edges: DataFrame, compartments: DataFrame, strip: float, rules: TariffRules = TariffRules()) -> DataFrame:
    """Volumes from raw tables: all trees, the first compartment that holds each, its species' form factor, then the tariff.

    ``edges`` are those of the compartments' polygons with poly_id the compartment; ``compartments`` has compartment and species. Trees without a place are in none.
    """
    placed = first_polygon(population(tops, diameters), edges, strip, "tree_id").withColumnRenamed("poly_id", "compartment")
    forms = compartments.select("compartment", S.form_factor(F.col("species"), rules.form).alias("form"))
    return tree_tariffs(placed.join(forms, "compartment", "left"), profiles, rules)


def compartment_rollup(volumes: DataFrame, compartments: DataFrame) -> DataFrame:
    """Trees, volume, mean diameter and height, volume per hectare and confidence of each compartment; those without trees too."""
    sums = volumes.where("compartment is not null").groupBy("compartment").agg(
        F.count(F.lit(1)).alias("n_trees"), F.sum("volume_m3").alias("volume_m3"), F.sum("volume_height_m3").alias("volume_height_m3"), F.avg("measured_dbh_cm").alias("dbh_mean"), F.avg("height_m").alias("height_mean"),
        F.sum(F.when(F.col("tier").startswith("circle"), F.col("volume_m3")).otherwise(0.0)).alias("volume_measured_m3"), F.count_if(F.col("tier") == "circle_fit_filtered").alias("n_samples"), F.bool_or("own_tariff").alias("_own"),
    )
    j = compartments.join(sums, "compartment", "left")
    return j.select(
        "compartment", F.coalesce("n_trees", F.lit(0)).cast("long").alias("n_trees"), F.coalesce("volume_m3", F.lit(0.0)).alias("volume_m3"), F.coalesce("volume_height_m3", F.lit(0.0)).alias("volume_height_m3"),
        "dbh_mean", "height_mean", F.coalesce("volume_measured_m3", F.lit(0.0)).alias("volume_measured_m3"), F.try_divide("volume_m3", "area_hectares").alias("volume_per_ha"),
        F.when(~F.coalesce("_own", F.lit(False)), "inherited").when(F.col("n_samples") >= 13, "high").otherwise("medium").alias("confidence"),
    )


def stand_rollup(volumes: DataFrame) -> DataFrame:
    """One row of stand totals by method and tier, with the histogram of tiers."""
    primary = F.col("tier") == "circle_fit_filtered"
    return volumes.agg(
        F.count(F.lit(1)).alias("n_trees"), F.sum("volume_m3").alias("volume_m3"), F.sum("volume_height_m3").alias("volume_height_m3"), F.sum(F.when(primary, F.col("volume_m3")).otherwise(0.0)).alias("volume_primary_m3"),
        F.sum(F.when(~primary, F.col("volume_m3")).otherwise(0.0)).alias("volume_augmented_m3"), F.count_if(primary).alias("n_samples"), F.avg("measured_dbh_cm").alias("dbh_mean"),
        F.count_if(F.col("tier") == "hd_model").alias("n_hd_model"), F.count_if(F.col("tier") == "circle_fit_weak").alias("n_weak"), F.count_if(F.col("tier") == "stand_mean").alias("n_stand_mean"),
    ).withColumn("confidence", F.when(F.col("n_samples") >= 13, "high").when(F.col("n_samples") >= 4, "medium").otherwise("low"))

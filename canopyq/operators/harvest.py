"""Harvest quoting: coupe context, canopy deficit, cycle times, hours, fuel and cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.functions import scalar as S


@dataclass(frozen=True)
class QuoteRules:
    """Rates of the quote; money and litres are doubles."""

    utilisation: float = 0.70
    harvest_fuel: float = 1.02
    forward_fuel: float = 0.90
    forward_rate: float = 16.5
    band: float = 0.18
    wide_band: float = 0.30
    small_dbh: float = 16.0
    hour_rate: float = 150.0
    fuel_price: float = 1.30
    blend: float = 0.7
    smearing: float = 1.0


def with_volume(stems: DataFrame) -> DataFrame:
    """Stems of positive volume; a missing or zero diameter takes the mean of its coupe's."""
    known = F.when(F.col("dbh_cm") > 0, F.col("dbh_cm"))
    means = stems.where("stem_volume_m3 > 0").groupBy("object_id").agg(F.avg(known).alias("_mean"))
    j = stems.where("stem_volume_m3 > 0").join(means, "object_id", "left")
    return j.withColumn("dbh_cm", F.coalesce(known, "_mean")).drop("_mean")


def coupe_context(stems: DataFrame) -> DataFrame:
    """Stems per hectare of the 1-99 % bounding box, and medians, of each coupe."""
    east, north = S.local_metres(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0))
    flat = stems.withColumns({"_e": F.col("lon") * 111320.0 * F.cos(F.radians("lat")), "_n": north})
    ends = lambda c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99)))
    box = flat.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_stems"), ends("_e").alias("_x"), ends("_n").alias("_y"), F.median("dbh_cm").alias("dbh_median"), F.median("stem_volume_m3").alias("volume_median"))
    area = (F.col("_x")[1] - F.col("_x")[0]) * (F.col("_y")[1] - F.col("_y")[0]) / 10000.0
    return box.select("object_id", "n_stems", area.alias("area_ha"), F.try_divide(F.col("n_stems"), F.greatest(area, F.lit(0.01))).alias("stems_per_ha"), "dbh_median", "volume_median")


def canopy_deficit(stems: DataFrame, width: float = 2.0) -> DataFrame:
    """How far each stem's canopy is below the 90th percentile of its diameter bin, not below 0."""
    binned = stems.withColumn("dbh_bin", F.floor(F.col("dbh_cm") / width) * width)
    tops = binned.groupBy("dbh_bin").agg(F.percentile("canopy_m", F.lit(0.9)).alias("envelope_m"))
    return binned.join(tops, "dbh_bin", "left").withColumn("deficit_m", F.greatest(F.col("envelope_m") - F.col("canopy_m"), F.lit(0.0)))


def predicted_cycles(stems: DataFrame, model: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Adds ``log_cycle`` from a fitted model, batch by batch; columns that are missing are given as nulls."""
    given = [F.col(c).cast("double").alias(c) if c in stems.columns else F.lit(None).cast("double").alias(c) for c in columns]

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(model(pd.concat(series, axis=1, keys=columns)), dtype=float)

    return stems.withColumn("log_cycle", predict(*given))


def blended_cycles(stems: DataFrame, rules: QuoteRules = QuoteRules()) -> DataFrame:
    """Cycle seconds: the model's log time blended with a line on log volume over all stems, then smeared."""
    line = stems.where("stem_volume_m3 > 0").withColumn("_lv", F.ln("stem_volume_m3")).agg(F.regr_slope("log_cycle", "_lv").alias("_a"), F.regr_intercept("log_cycle", "_lv").alias("_b"))
    j = stems.crossJoin(F.broadcast(line))  # one row
    guard = F.col("_a") * F.ln(F.greatest("stem_volume_m3", F.lit(1e-3))) + F.col("_b")
    return j.withColumn("cycle_s", F.exp(F.col("log_cycle") * rules.blend + guard * (1 - rules.blend)) * rules.smearing).drop("_a", "_b")


def coupe_quotes(stems: DataFrame, rules: QuoteRules = QuoteRules()) -> DataFrame:
    """Volume, hours, fuel, cost and band of each coupe; small median diameters widen the band."""
    sums = stems.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_stems"), F.sum("stem_volume_m3").alias("volume_m3"), (F.sum("cycle_s") / 3600.0).alias("cut_h"), F.median("dbh_cm").alias("dbh_median"))
    hours = F.col("cut_h") / rules.utilisation + F.col("volume_m3") / rules.forward_rate
    fuel = F.col("volume_m3") * (rules.harvest_fuel + rules.forward_fuel)
    small = F.col("dbh_median") < rules.small_dbh
    out = sums.withColumns({"m3_per_pmh": F.try_divide("volume_m3", "cut_h"), "machine_h": hours, "fuel_l": fuel, "windblow": small, "band": F.when(small, rules.wide_band).otherwise(rules.band)})
    cost = F.col("machine_h") * rules.hour_rate + F.col("fuel_l") * rules.fuel_price
    return out.withColumn("cost", cost).withColumns({"cost_low": F.col("cost") * (1 - F.col("band")), "cost_high": F.col("cost") * (1 + F.col("band"))})


def quote_total(coupes: DataFrame, rules: QuoteRules = QuoteRules()) -> DataFrame:
    """One row over all coupes; a single uncertain coupe widens the band."""
    low = F.coalesce(F.bool_or("windblow"), F.lit(False))
    return coupes.agg(F.count(F.lit(1)).alias("n_coupes"), F.sum("n_stems").alias("n_stems"), F.sum("volume_m3").alias("volume_m3"), F.sum("machine_h").alias("machine_h"), F.sum("fuel_l").alias("fuel_l"), F.sum("cost").alias("cost"), F.when(low, rules.wide_band).otherwise(rules.band).alias("band"))


def stems_from_strata(strata: DataFrame, seed: int = 1) -> DataFrame:
    """Synthetic stems of strata (species, n_stems, mean_dbh_cm, total_volume_m3): normal diameters of 20 % deviation, volume in proportion to their square."""
    each = strata.withColumn("stem_no", F.explode(F.sequence(F.lit(1), F.col("n_stems").cast("int"))))
    sized = each.withColumn("dbh_cm", S.clamp(F.col("mean_dbh_cm") * (F.randn(seed) * 0.2 + 1.0), 5.0, 120.0))
    total = sized.groupBy("species").agg(F.sum(F.col("dbh_cm") * F.col("dbh_cm")).alias("_s"))
    return sized.join(total, "species").withColumn("stem_volume_m3", F.col("total_volume_m3") * F.col("dbh_cm") * F.col("dbh_cm") / F.col("_s")).drop("_s")


def merge_terrain(stems: DataFrame, terrain: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Stems with terrain by (object_id, stem_key), the last duplicate by ``order`` winning, NaN as null; and the share of stems covered."""
    names = [c for c in terrain.columns if c not in ("object_id", "stem_key", order)]
    last = terrain.groupBy("object_id", "stem_key").agg(F.max_by(F.struct(*names), order).alias("_t"))
    clean = [F.when(~F.isnan(F.col(f"_t.{c}").cast("double")), F.col(f"_t.{c}")).alias(c) for c in names]
    j = stems.join(last, ["object_id", "stem_key"], "left")
    out = j.select(*stems.columns, *clean)
    return out, out.agg(F.avg(F.col(names[0]).isNotNull().cast("double")).alias("coverage"))

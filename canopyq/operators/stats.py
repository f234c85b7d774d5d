"""Grouped statistics: robust means, regression, weighted lines, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robust_mean(df: DataFrame, value: str, by: list[str], limit: float = 2.5, least: int = 4) -> DataFrame:
    """Mean after one round of dropping values farther than ``limit`` population deviations; groups below ``least`` keep all.

    Two aggregations: the second joins the first's few rows. A group whose values would all go keeps all.
    """
    known = df.where(F.col(value).isNotNull())
    first = known.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n"))
    joined = known.join(first, by) if by else known.crossJoin(first)  # one row
    kept = (F.col("_n") < least) | (F.abs(F.col(value) - F.col("_m")) <= F.col("_s") * limit)
    out = joined.groupBy(*by).agg(F.count(value).alias("n"), F.avg(F.when(kept, F.col(value))).alias("_r"), F.avg(value).alias("_a"), F.count_if(~kept).alias("_d"))
    return out.select(*by, "n", F.coalesce("_r", "_a").alias("robust_mean"), F.when(F.col("_r").isNull(), 0).otherwise(F.col("_d")).cast("long").alias("n_dropped"))


def line_fit(y: str, x: str) -> list[Column]:
    """Aggregates of a least-squares line: slope, intercept, r2, n. Below 3 pairs or without spread: the mean."""
    n = F.regr_count(y, x)
    ok = (n >= 3) & (F.regr_sxx(y, x) > 0)
    return [
        F.when(ok, F.regr_slope(y, x)).otherwise(0.0).alias("slope"), F.when(ok, F.regr_intercept(y, x)).otherwise(F.regr_avgy(y, x)).alias("intercept"),
        F.when(ok, F.regr_r2(y, x)).otherwise(0.0).alias("r2"), n.cast("long").alias("n"),
    ]


def weighted_line(y: Column, x: Column, w: Column) -> tuple[Column, Column]:
    """Aggregates of a weighted least-squares line: slope and intercept; null slope without spread."""
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxx, sxy = F.sum(w * x * x), F.sum(w * x * y)
    slope = F.try_divide(sw * sxy - sx * sy, sw * sxx - sx * sx)
    return slope, F.try_divide(sy - slope * sx, sw)


def effective_count(w: Column) -> Column:
    return F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, min, max, mean, population deviation, quartiles and median of a value."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std"),
        F.percentile(v, F.lit(0.25)).alias("v_p25"), F.median(v).alias("v_median"), F.percentile(v, F.lit(0.75)).alias("v_p75"),
    )


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    names = df.columns
    value = F.struct(*names)
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("_row")).select("_row.*")


def argmax_share(df: DataFrame, by: list[str], kind: str, amount: str) -> DataFrame:
    """For each key the kind with the largest total; ties go to the smaller kind."""
    totals = df.groupBy(*by, kind).agg(F.sum(amount).alias("_t"))
    order = Window.partitionBy(*by).orderBy(F.desc("_t"), F.asc(kind))
    return totals.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*by, kind, F.col("_t").alias("total"))


def set_differences(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """How many keys each set has that another lacks: (present_in, missing_in, n)."""
    marks = None
    for name, df in sets.items():
        part = df.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("name", F.lit(name))
        marks = part if marks is None else marks.unionByName(part)
    seen = marks.groupBy("key").agg(*(F.max(F.col("name") == n).alias(n) for n in sets))
    counts = seen.agg(*(F.count_if(F.col(a) & ~F.col(b)).alias(f"{a}|{b}") for a in sets for b in sets if a != b))
    pairs = [f"{a}|{b}" for a in sets for b in sets if a != b]
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p.split("|")[0]).alias("present_in"), F.lit(p.split("|")[1]).alias("missing_in"), F.col(f"`{p}`").cast("long").alias("n")) for p in pairs))).alias("r")).select("r.*")


def numbered(df: DataFrame, block: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers rows 1 to n by block, then by order inside it.

    Blocks are numbered by themselves and moved on by the rows of the blocks before: only one row for each block is summed in one task.
    """
    sizes = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*(F.col(b).alias(f"_b_{b}") for b in block), F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in block))
    place = F.row_number().over(Window.partitionBy(*block).orderBy(*order))
    return df.join(starts, same).select(*df.columns, (place + F.col("_before")).cast("long").alias(name))


def strided(df: DataFrame, most: int, block: list[str], order: list[str]) -> DataFrame:
    """Every k-th row in order, from the first, with the least k that leaves at most ``most``: a sample spread evenly. Counts the rows when called."""
    step = max(1, -(-df.count() // most))
    return numbered(df, block, order, "_number").where((F.col("_number") - 1) % step == 0).drop("_number")


def required(df: DataFrame, names: set[str]) -> DataFrame:
    """``df`` itself; raises if a named column is missing."""
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

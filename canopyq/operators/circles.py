"""Circle fits of stem slices in numpy, one group a slice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.035, 0.25


def _refined(x: np.ndarray, y: np.ndarray, start: tuple[float, float, float], steps: int = 30, low: float = LOW, high: float = HIGH, weight: np.ndarray | None = None) -> tuple[float, float, float]:
    """Least squares of distance minus radius by damped Gauss-Newton with the radius kept in bounds; a point counts ``weight`` times."""
    p, damp = np.array(start, float), 1e-3
    root = np.ones(len(x)) if weight is None else np.sqrt(weight)

    def residual(q: np.ndarray) -> np.ndarray:
        return (np.hypot(x - q[0], y - q[1]) - q[2]) * root

    r = residual(p)
    for _ in range(steps):
        d = np.maximum(np.hypot(x - p[0], y - p[1]), 1e-9)
        jacobian = np.stack([(p[0] - x) / d, (p[1] - y) / d, -np.ones_like(d)], 1) * root[:, None]
        a, g = jacobian.T @ jacobian, jacobian.T @ r
        try:
            q = p - np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g)
        except np.linalg.LinAlgError:
            break
        q[2] = min(max(q[2], low), high)
        s = residual(q)
        if s @ s < r @ r:
            small = np.abs(q - p).max() < 1e-9
            p, r, damp = q, s, damp / 3
            if small:
                break
        else:
            damp *= 5
            if damp > 1e6:
                break
    return float(p[0]), float(p[1]), float(p[2])


def robust_circle(x: np.ndarray, y: np.ndarray, rounds: int = 3, least: int = 6) -> tuple[float, float, float, float, int] | None:
    """Centre, radius, mean absolute residual and inliers; points within 2.5 robust deviations, of the residuals' sizes from their median, are refitted until they stay the same.

    None with fewer than ``least`` inliers or a radius at its bounds.
    """
    if len(x) < least:
        return None
    cx, cy = float(np.median(x)), float(np.median(y))
    fit = cx, cy, min(max(float(np.median(np.hypot(x - cx, y - cy))), LOW), HIGH)
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        fit = _refined(x[inside], y[inside], fit)
        error = np.abs(np.hypot(x - fit[0], y - fit[1]) - fit[2])
        limit = min(max(1.4826 * float(np.median(np.abs(error - np.median(error)))) * 2.5, 0.010), 0.050)
        now = error <= limit
        if now.sum() < least:
            return None
        if (now == inside).all():
            break
        inside = now
    fit = _refined(x[inside], y[inside], fit)
    if not LOW < fit[2] < HIGH:
        return None
    return *fit, float(np.abs(np.hypot(x[inside] - fit[0], y[inside] - fit[1]) - fit[2]).mean()), int(inside.sum())


def annulus_refit(x: np.ndarray, y: np.ndarray, fit: tuple[float, float, float], shrink: float = 1.0, least: int = 6) -> tuple[float, float, float, float, int]:
    """Refit on points near the circle (half width a fifth of the radius within 8 to 40 mm); the first fit if too few are."""
    half = min(max(0.2 * fit[2], 0.008), 0.04)
    ring = np.abs(np.hypot(x - fit[0], y - fit[1]) - fit[2]) <= half
    if ring.sum() >= least:
        fit = _refined(x[ring], y[ring], fit)
    error = np.abs(np.hypot(x - fit[0], y - fit[1]) - fit[2])
    return fit[0], fit[1], fit[2] * shrink, float(error[ring].mean()) if ring.any() else float("nan"), int(ring.sum())


def slice_fits(points: DataFrame, by: list[str], shrink: float = 1.0) -> DataFrame:
    """Circle of each slice of points (x, y): centre, radius, residual, coverage, interior share and counts; null where no circle fits."""
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by) + ", cx double, cy double, radius_m double, residual_m double, coverage_deg double, interior_ratio double, n_points long, n_inliers long, n_ring_points long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        found = robust_circle(x, y)
        row: list = [None] * 6 + [len(x), 0, 0]
        if found:
            cx, cy, r, residual, ring = annulus_refit(x, y, found[:3], shrink)
            near = np.abs(np.hypot(x - cx, y - cy) - r) <= 0.05
            angle = np.degrees(np.arctan2(y[near] - cy, x[near] - cx)) % 360
            row = [cx, cy, r, residual, float(len(np.unique(angle // 10)) * 10), float((np.hypot(x - cx, y - cy) < 0.55 * r).mean()), len(x), found[4], ring]
        return pd.DataFrame([[*key, *row]])

    return points.select(*by, "x", "y").groupBy(*by).applyInPandas(run, schema)


#: Heights of the slices that seeds are fitted on, their step, least points of one, radii of a stem, and slices that a seed needs.
SEED_FROM, SEED_TO, SEED_STEP, SEED_POINTS, SEED_RADII, SEED_SLICES = 0.5, 5.0, 0.2, 10, (0.035, 0.4), 3


def _median(values: np.ndarray, weight: np.ndarray) -> float:
    """Median of values that each stand ``weight`` times."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weight[order])
    return float(values[order][np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right")].mean())


def seed_circle(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float, float, float] | None:
    """Centre, radius and cost, half the squared residuals, of a plain least-squares circle; None if its radius is no stem's. A point counts ``weight`` times, a whole number."""
    weight = np.ones(len(x), np.int64) if weight is None else weight
    start = float(np.average(x, weights=weight)), float(np.average(y, weights=weight))
    start = *start, max(_median(np.hypot(x - start[0], y - start[1]), weight), 0.05)
    cx, cy, r = _refined(x, y, start, steps=100, low=-np.inf, high=np.inf, weight=weight)
    if not SEED_RADII[0] < abs(r) < SEED_RADII[1]:
        return None
    return cx, cy, abs(r), float(0.5 * (weight * (np.hypot(x - cx, y - cy) - r) ** 2).sum())


def seed_fits(points: DataFrame, by: str = "tree_id", copies: str | None = None) -> DataFrame:
    """Circles of the slices of each tree's lower stem, as (tree, slice, cx, cy, r, cost); slices with few points or no stem's radius have none.

    Points of no tree, with an id of 0 or less, are left out. ``copies`` is how many points a row stands for. One group is one slice of one tree; fits cost far more than their rows weigh, so
    they are dealt to all shuffle partitions.
    """
    kind = points.schema[by].dataType.simpleString()
    place = F.floor((F.col("z") - SEED_FROM) / SEED_STEP).cast("int")
    slices = points.where(F.col(by) > 0).select(by, "x", "y", (F.col(copies) if copies else F.lit(1)).cast("long").alias("_n"), place.alias("slice")).where(F.col("slice").between(0, round((SEED_TO - SEED_FROM) / SEED_STEP + 0.5) - 1))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = pdf["_n"].to_numpy()
        found = seed_circle(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), number) if number.sum() >= SEED_POINTS else None
        return pd.DataFrame([[*key, *found]] if found else [], columns=[by, "slice", "cx", "cy", "r", "cost"])

    dealt = slices.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), by, "slice")
    return dealt.groupBy(by, "slice").applyInPandas(run, f"{by} {kind}, slice int, cx double, cy double, r double, cost double")


def seeds(trees: DataFrame, fits: DataFrame, by: str = "tree_id", least: int = SEED_SLICES) -> DataFrame:
    """The seed of each tree: medians of its slices' centres and radii and the mean cost, null below ``least`` slices; trees without a fit too.

    ``trees`` has the tree and n_points.
    """
    known = lambda c: F.when(F.count(F.lit(1)) >= least, c)
    middle = fits.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), *(known(F.median(c)).alias(f"seed_{n}") for c, n in (("cx", "cx"), ("cy", "cy"), ("r", "r_m"))), known(F.avg("cost")).alias("seed_mean_cost")
    )
    number = F.coalesce("_n", F.lit(0)).cast("long")
    status = F.when(F.col("n_points") == 0, "empty_tree").when(number < least, "insufficient_seed_slices").otherwise("seed_ok")
    return trees.select(by, "n_points").join(middle, by, "left").select(by, status.alias("seed_status"), "seed_cx", "seed_cy", "seed_r_m", number.alias("seed_n_slices"), "seed_mean_cost")

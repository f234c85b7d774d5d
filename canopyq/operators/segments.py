"""Tree segmentation: non-maximum suppression, smoothing, seeded watershed, density, radial and linearity filters."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.operators.neighbours import linearity  # noqa: F401
from canopyq.plans.storage import discard, stored


def _settled(rank: list[int], x: list[float], y: list[float], state: list[int], own: list[bool], distance: float) -> list[int]:
    """States of tops in order of ``rank`` as far as they follow: 1 kept, 0 dropped, -1 open. Given states stay, and those of tops that aren't the tile's own, since
    better ones near these may not be at hand; a top whose fate hangs on an open one is open."""
    out, cells = list(state), {}
    for i in rank:
        cx, cy = math.floor(x[i] / distance), math.floor(y[i] / distance)
        if out[i] == -1 and own[i]:
            fate = 1
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    for j in cells.get((cx + a, cy + b), ()):
                        if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 < distance * distance:
                            fate = 0 if out[j] == 1 or fate == 0 else -1
            out[i] = fate
        if out[i]:
            cells.setdefault((cx, cy), []).append(i)
    return out


def suppressed(tops: DataFrame, distance: float, key: str = "tree_id", height: str = "height_m", tile: float | None = None) -> DataFrame:
    """Greedy non-maximum suppression: from the highest down, a top stays unless a kept one is nearer than ``distance``.

    Equal heights go by key, so the order is total. Tiles of side ``tile`` (64 distances if not given), with the tops within ``distance`` around them, settle all that follows from what
    they hold, in one task each; tops whose fate hangs on an open one beyond the tile wait for the next round, in which only such tiles run. So rounds follow how many tiles a chain of
    tops crosses, not its length; each is written to the shared folder. Tops without a place or height are left out.
    """
    side = tile or 64 * distance
    kind = tops.schema[key].dataType.simpleString()
    placed = tops.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(height).isNotNull())
    rows = placed.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(height).cast("double").alias("h"), F.lit(-1).alias("state"))
    state = stored(rows.withColumns({"own_i": F.floor(F.col("x") / side), "own_j": F.floor(F.col("y") / side)}), "tops")
    spans = {c: F.explode(F.array_distinct(F.array(F.floor((F.col(v) - distance) / side), F.floor(F.col(v) / side), F.floor((F.col(v) + distance) / side)))) for c, v in (("ti", "x"), ("tj", "y"))}
    schema = f"key {kind}, x double, y double, h double, state int, own_i long, own_j long"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["own_i"] == pdf["ti"]) & (pdf["own_j"] == pdf["tj"])
        rank = pdf.assign(at=range(len(pdf))).sort_values(["h", "key"], ascending=[False, True])["at"].tolist()
        found = _settled(rank, pdf["x"].tolist(), pdf["y"].tolist(), pdf["state"].tolist(), own.tolist(), distance)
        return pdf.assign(state=found)[own][["key", "x", "y", "h", "state", "own_i", "own_j"]]

    while True:
        waiting = state.where("state = -1").select(F.col("own_i").alias("ti"), F.col("own_j").alias("tj")).distinct()
        if waiting.isEmpty():
            kept = state.where("state = 1").select(F.col("key").alias(key))
            return tops.join(kept, key, "left_semi")
        dealt = state.withColumn("ti", spans["ti"]).withColumn("tj", spans["tj"]).join(waiting, ["ti", "tj"], "left_semi")
        done = dealt.groupBy("ti", "tj").applyInPandas(settle, schema)
        rest = state.join(waiting.select(F.col("ti").alias("own_i"), F.col("tj").alias("own_j")), ["own_i", "own_j"], "left_anti")
        before, state = state, stored(rest.select(state.columns).unionByName(done), "tops")
        discard(before)


def smoothed(grid: DataFrame, sigma: float = 1.0, truncate: float = 4.0, everywhere: bool = False, single: bool = False) -> DataFrame:
    """Separable Gaussian on a grid with borders reflected at its outermost cells; absent cells count 0.

    Each cell sends its share to the cells it reaches along one axis, and sums go on along the other: two aggregations, no dense array anywhere. With ``everywhere`` absent cells that
    some share reaches have a value too; with ``single`` each pass is rounded to a float.
    """
    half = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    weights = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-half, half + 1), raw, strict=True)))
    ends = grid.agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))

    def one(values: DataFrame, axis: str, low: str, high: str) -> DataFrame:
        other, n = "col" if axis == "row" else "row", F.col(high) - F.col(low) + 1
        placed = values.crossJoin(F.broadcast(ends)).withColumn("_p", F.col(axis) - F.col(low)).withColumn("_n", n)  # one row of ends
        turns = F.transform(F.sequence(F.floor(-half / (F.col("_n") * 2)) - 1, F.floor((F.col("_n") + half) / (F.col("_n") * 2)) + 1), lambda m: m * F.col("_n") * 2)
        images = F.flatten(F.transform(turns, lambda t: F.array(F.col("_p") + t, -1 - F.col("_p") + t)))
        near = F.filter(images, lambda v: (v >= -half) & (v < F.col("_n") + half))
        sent = placed.withColumn("_v", F.explode(near)).withColumn("_t", F.explode(weights)).withColumn("_to", F.col("_v") + F.col("_t.k")).where((F.col("_to") >= 0) & (F.col("_to") < F.col("_n")))
        total = F.sum(F.col("_t.w") * F.col("value"))
        return sent.groupBy((F.col("_to") + F.col(low)).cast("int").alias(axis), other).agg((total.cast("float") if single else total).alias("value")).select("row", "col", "value")

    out = one(one(grid.select("row", "col", "value"), "row", "_r0", "_r1"), "col", "_c0", "_c1")
    return out if everywhere else out.join(grid.select("row", "col"), ["row", "col"], "left_semi")


def _flooded(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, seeds: dict[tuple[int, int], int], edge: np.ndarray, diagonals: bool = True) -> np.ndarray:
    """Place of the seed, in order of label, that floods each cell: -1 where none does, -2 where a flood from beyond a cell of ``edge`` may come first.

    Edge cells flood from the start and win ties, so no flood from beyond can be earlier; order depends on a cell's own value, steps and place, never on the
    window. What a seed still reaches first is therefore the same in any wider window.
    """
    place = {(r, c): i for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True))}
    owner = np.full(len(rows), -1, np.int64)
    heap: list[tuple[float, int, int, int, int]] = []

    def reach(i: int, name: int, steps: int) -> None:
        owner[i] = name
        heapq.heappush(heap, (-values[i], -1 if name == -2 else steps, int(rows[i]), int(cols[i]), i))

    for k, (cell, _) in enumerate(sorted(seeds.items(), key=lambda s: s[1])):
        if cell in place:
            reach(place[cell], k, 0)
    for i in np.flatnonzero(edge & (owner == -1)).tolist():
        reach(i, -2, 0)
    while heap:
        _, steps, r, c, i = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                j = place.get((r + a, c + b)) if diagonals or not (a and b) else None
                if j is not None and owner[j] == -1:
                    reach(j, owner[i], steps + 1)
    return owner


def watershed_kernel(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, seeds: dict[tuple[int, int], int]) -> np.ndarray:
    """Labels of cells flooded from seeds in descending value over 8 neighbours; 0 where no seed reaches. Ties flood by steps from the seed, then by place."""
    names = np.array([*sorted(seeds.values()), 0], np.int64)
    return names[_flooded(rows, cols, values, seeds, np.zeros(len(rows), bool))]


def watershed(grid: DataFrame, seeds: DataFrame, tile: int = 400, halo: int = 40, least: float = 0.0, diagonals: bool = True) -> DataFrame:
    """Seeded watershed of cells with value at least ``least``: (row, col, label), flooded per tile with a halo; any label counts, negative ones too.

    Floods cross corners of cells too, unless ``diagonals`` is false.

    Each cell's label comes from the tile that owns it. A tile that a flood from beyond its halo may reach is done again with twice the halo, until
    all labels are those of the whole grid. A task holds one buffered tile; only a flood that crosses the whole raster widens it that far.
    """
    cells = stored(grid.where(F.col("value") >= least).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")), "cells")
    starts = stored(seeds.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("label").cast("long").alias("label")), "seeds")
    ends = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if ends[0] is None or starts.isEmpty():
        return starts.limit(0)

    def flooded(halo: int, tiles: DataFrame | None) -> DataFrame:
        def spans(c: str, low: int, high: int) -> Column:
            first, last = F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)
            return F.sequence(F.greatest(first, F.lit(low // tile)), F.least(last, F.lit(high // tile)))

        def dealt(df: DataFrame) -> DataFrame:
            inside = df.where(F.col("row").between(ends[0], ends[1]) & F.col("col").between(ends[2], ends[3]))
            out = inside.withColumn("ti", F.explode(spans("row", ends[0], ends[1]))).withColumn("tj", F.explode(spans("col", ends[2], ends[3])))
            return out if tiles is None else out.join(tiles, ["ti", "tj"], "left_semi")

        def flood(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows, cols = left["row"].to_numpy(), left["col"].to_numpy()
            edge = np.zeros(len(left), bool)
            for at, k, low, high in ((rows, key[0], ends[0], ends[1]), (cols, key[1], ends[2], ends[3])):
                begin, end = k * tile - halo, (k + 1) * tile - 1 + halo
                edge |= ((at == begin) & (begin > low)) | ((at == end) & (end < high))
            given = {(r, c): n for r, c, n in zip(right["row"], right["col"], right["label"], strict=True)}
            found = _flooded(rows, cols, left["value"].to_numpy(), given, edge, diagonals)
            own = (rows // tile == key[0]) & (cols // tile == key[1])
            if (found[own] == -2).any():
                return pd.DataFrame({"row": [None], "col": [None], "label": [None], "ti": [key[0]], "tj": [key[1]]})
            own &= found >= 0
            label = np.array([*sorted(given.values()), 0], np.int64)[found[own]]
            return pd.DataFrame({"row": rows[own], "col": cols[own], "label": label, "ti": key[0], "tj": key[1]})

        pairs = dealt(cells).groupBy("ti", "tj").cogroup(dealt(starts).groupBy("ti", "tj"))
        return stored(pairs.applyInPandas(flood, "row int, col int, label long, ti long, tj long"), "flooded")

    tiles, parts = None, []
    while True:
        out = flooded(halo, tiles)
        parts.append(out.where("row is not null").select("row", "col", "label"))
        tiles = out.where("row is null").select("ti", "tj")
        if tiles.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        halo = max(1, halo * 2)


def crown_summary(labels: DataFrame, size: float) -> DataFrame:
    """Cells, area and equivalent diameter of each crown."""
    area = F.count(F.lit(1)) * (size * size)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"), area.alias("area_m2"), (F.sqrt(area / math.pi) * 2.0).alias("diameter_m"))


def dense_enough(points: DataFrame, group: str, least: int = 20, copies: str | None = None) -> DataFrame:
    """Points of groups below ``least`` lose their group (id 0) and stay; ``copies`` is how many points a row stands for."""
    counts = points.groupBy(group).agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("_n"))
    return points.join(counts, group, "left").withColumn(group, F.when(F.col("_n") < least, 0).otherwise(F.col(group))).select(*points.columns)


def radial_filter(points: DataFrame, centres: DataFrame, key: str = "tree_id", radius: float = 0.9, least: int = 10, copies: str | None = None) -> DataFrame:
    """Points within ``radius`` of their tree's centre; trees of which fewer than ``least`` would remain keep all. ``kept`` and the tree's share are columns.

    ``copies`` is how many points a row stands for.
    """
    number = F.col(copies) if copies else F.lit(1)
    j = points.join(centres.select(key, F.col("x").alias("_cx"), F.col("y").alias("_cy")), key, "left")
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    near = j.withColumn("_near", F.coalesce(dx * dx + dy * dy <= radius * radius, F.lit(True)))
    counts = near.groupBy(key).agg(F.sum(F.when(F.col("_near"), number).otherwise(0)).alias("_k"), F.sum(number).alias("_n"))
    out = near.join(counts, key).withColumn("kept", F.col("_near") | (F.col("_k") < least))
    return out.select(*points.columns, "kept", F.when(F.col("_k") < least, 1.0).otherwise(F.col("_k") / F.col("_n")).alias("retention"))


def principal_axes(points: DataFrame, by: str, copies: str | None = None) -> DataFrame:
    """Linearity, (l1 - l2) / l1 of its variances, and verticality of each segment from its covariance: sums are partial aggregates, the eigenvectors of one 3 x 3 matrix a row.

    With ``copies``, how many points a row stands for, products are summed about the segment's mean.
    """
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    if copies:
        means = points.groupBy(by).agg(F.sum(copies).alias("_n"), *((F.sum(F.col(copies) * F.col(c)) / F.sum(copies)).alias(f"_{c}") for c in "xyz"))
        off = points.join(means, by).select(by, "_n", F.col(copies).alias("_w"), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"))
        products = (F.try_divide(F.sum(F.col("_w") * F.col(a) * F.col(b)), F.first("_n") - 1).alias(f"c{a}{b}") for a, b in pairs)
        cov = off.groupBy(by).agg(F.first("_n").alias("n"), *products)
    else:
        cov = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs))

    @F.pandas_udf("struct<linearity: double, verticality: double>")
    def axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.nan_to_num(np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1).astype(float))
        values, vectors = np.linalg.eigh(m)
        share = values / np.maximum(values.sum(1, keepdims=True), np.finfo(float).tiny)
        return pd.DataFrame({"linearity": (share[:, 2] - share[:, 1]) / (share[:, 2] + 1e-9), "verticality": np.abs(vectors[:, 2, 2])})

    return cov.select(by, "n", axes(*(F.col(f"c{a}{b}") for a, b in pairs)).alias("a")).select(by, "n", "a.*")


def segment_tiers(segments: DataFrame, most_failures: int = 3) -> DataFrame:
    """Failures, reasons and tier of segments by their linearity, verticality, drift and final count."""
    checks = {"low_linearity": F.col("linearity") < 0.6, "not_vertical": F.col("verticality") < 0.7, "drifting": F.col("drift_mean") > 0.3, "empty": F.col("n_points") == 0}
    reasons = F.filter(F.array(*(F.when(c, n) for n, c in checks.items())), lambda r: r.isNotNull())
    out = segments.withColumn("fail_reasons", F.array_join(reasons, ";")).withColumn("failures", F.size(reasons))
    status = F.when((F.col("failures") >= most_failures) | (F.col("n_points") == 0), "rejected").otherwise("accepted")
    return out.withColumn("segment_status", status).withColumn("segment_qc_tier", F.when(status == "rejected", "reject").when(F.col("failures") == 0, "high").when(F.col("failures") == 1, "medium").otherwise("low"))


@dataclass(frozen=True)
class ScoreRules:
    """Limits of a segment's score: points, linearity and verticality, slices, mean and largest drift in metres, failures that reject."""

    points: int = 30
    linearity: float = 0.45
    verticality: float = 0.55
    slices: int = 3
    drift_mean: float = 0.25
    drift_max: float = 0.50
    failures: int = 3


def segment_scores(segments: DataFrame, rules: ScoreRules = ScoreRules(), reject_empty: bool = True) -> DataFrame:
    """Failures, reasons, status and tier of candidate segments.

    ``segments`` has n_points, linearity, verticality, n_slices, drift_mean and drift_max. Too few points or low linearity is a failure; verticality, slices and
    drift only warn. A candidate is rejected at ``rules.failures`` failures, more than these two checks give by themselves. A segment without points is
    rejected, unless ``reject_empty`` is false: then it has too few points like others.
    """
    few = F.coalesce(F.col("n_points"), F.lit(0)) < rules.points
    bent = ~few & (F.col("linearity") < rules.linearity)
    leaning = ~few & (F.col("verticality") < rules.verticality)
    short = F.coalesce(F.col("n_slices"), F.lit(0)) < rules.slices
    drifting = ~short & (F.col("drift_mean") > rules.drift_mean) & (F.col("drift_max") > rules.drift_max)
    marks = [
        F.when(few, "too_few_points"), F.when(bent, F.format_string("linearity=%.2f", "linearity")), F.when(leaning, F.format_string("verticality_warn=%.2f", "verticality")),
        F.when(short, "too_few_slices_warn"), F.when(drifting, F.format_string("drift_warn=%.2f", "drift_mean")),
    ]
    empty = (F.coalesce(F.col("n_points"), F.lit(0)) == 0) & F.lit(reject_empty)
    failures = F.coalesce(few, F.lit(False)).cast("int") + F.coalesce(bent, F.lit(False)).cast("int")
    reasons = F.when(empty, "empty_after_density_filter").otherwise(F.array_join(F.array(*marks), ";"))
    out = segments.withColumn("fail_reasons", reasons).withColumn("failures", F.when(empty, rules.failures).otherwise(failures))
    rejected, warned = F.col("failures") >= rules.failures, F.col("failures") == 1
    return out.withColumns({
        "segment_status": F.when(rejected, "rejected_after_scoring").when(warned, "accepted_with_warning").otherwise("good_candidate"),
        "segment_qc_tier": F.when(rejected, "failed").when(warned, "moderate").otherwise("good"),
    })

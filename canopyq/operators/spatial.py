"""Spatial joins by cell-bucketed equi joins: radius, nearest neighbour, point in polygon, majority matches."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.operators.neighbours import count_within, k_nearest, placed_rows
from canopyq.plans.storage import stored


def _cells(size: float, x: str, y: str) -> tuple[Column, Column]:
    return F.floor(F.col(x) / size), F.floor(F.col(y) / size)


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (x, y) and right (rx, ry) rows at most ``radius`` apart, with ``dist2``.

    Left rows go to their 3 x 3 cells of side ``radius``; the join is on the cell, so no pair of far cells is ever formed.
    """
    cx, cy = _cells(radius, "x", "y")
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = left.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns({"_cx": cx + F.col("_dx"), "_cy": cy + F.col("_dy")}).drop("_dx", "_dy")
    rx, ry = _cells(radius, "rx", "ry")
    joined = spread.join(right.withColumns({"_cx": rx, "_cy": ry}), ["_cx", "_cy"]).drop("_cx", "_cy")
    dist2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    return joined.withColumn("dist2", dist2).where(F.col("dist2") <= radius * radius)


def radius_count(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    """Number of other points within ``radius`` of each point; cells inside the circle add their counts, so dense places form no pairs."""
    placed = points.select(key, "x", "y")
    counts = count_within(placed, placed, radius, key).withColumnRenamed("n", "_n")
    return points.join(counts, key, "left").select(*points.columns, F.coalesce(F.col("_n") - 1, F.lit(0)).cast("long").alias("n_near"))


#: Side, in small cells, of the squares in which ``crowded`` looks for rows near sparse cells.
_SQUARE = 16


def crowded(points: DataFrame, radius: float, least: int, copies: str | None = None, key: str = "point_id") -> DataFrame:
    """Points with at least ``least`` others within ``radius``; ``copies`` is how many points a row stands for. The answer is that of ``radius_count``, without the counts.

    A small cell of more points whose box fits in the radius answers for all of them. Only rows of sparser cells are counted, against the rows of squares near them, where a row
    stands for ``least`` + 1 points at most: more can't change the answer.
    """
    if least < 1:
        return points
    number, side, square = F.col(copies) if copies else F.lit(1), radius / math.sqrt(2), lambda c: F.floor(c / _SQUARE)
    points = placed_rows(points, ("x", "y"))
    placed = points.withColumns({"_i": F.floor(F.col("x") / side), "_j": F.floor(F.col("y") / side)})
    cells = placed.groupBy("_i", "_j").agg(F.sum(number).alias("_n"), (F.max("x") - F.min("x")).alias("_w"), (F.max("y") - F.min("y")).alias("_h"))
    fits = F.col("_w") * F.col("_w") + F.col("_h") * F.col("_h") <= radius * radius
    sparse = stored(cells.where((F.col("_n") <= least) | ~fits).select("_i", "_j"), "sparse")
    if sparse.isEmpty():
        return points
    spans = {f"_s{c}": F.explode(F.array_distinct(F.array(square(F.col(c) - 2), square(F.col(c) + 2)))) for c in ("_i", "_j")}
    squares = sparse.withColumn("_s_i", spans["_s_i"]).withColumn("_s_j", spans["_s_j"]).select("_s_i", "_s_j").distinct()
    near = placed.withColumns({"_s_i": square(F.col("_i")), "_s_j": square(F.col("_j"))}).join(squares, ["_s_i", "_s_j"], "left_semi")
    others = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(number, F.lit(least + 1)).cast("int")))).select(key, "x", "y")
    asked = stored(placed.join(sparse, ["_i", "_j"], "left_semi"), "asked")
    enough = count_within(asked.select(key, "x", "y"), others, radius, key).where(F.col("n") > least).select(key)
    return placed.join(sparse, ["_i", "_j"], "left_anti").unionByName(asked.join(enough, key, "left_semi")).select(points.columns)


def radius_max(seeds: DataFrame, points: DataFrame, radius: float, key: str, fallback: str) -> DataFrame:
    """Highest point within ``radius`` of each seed, else the seed's own ``fallback``."""
    tops = within(seeds, points.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("_z")), radius).groupBy(key).agg(F.max("_z").alias("_top"))
    return seeds.join(tops, key, "left").select(*seeds.columns, F.coalesce("_top", fallback).alias("top_z"))


def nearest(left: DataFrame, right: DataFrame, key: str = "point_id", right_key: str = "ground_id") -> DataFrame:
    """The nearest right row (``right_key``, x, y) of each left row, ties to the smaller key: (key, right_key, distance).

    An empty right side gives no row; rows without coordinates have none either.
    """
    found = k_nearest(left, right, 1, ("x", "y"), None, key, right_key)
    return found.where(F.size("keys") > 0).select(key, F.get("keys", F.lit(0)).alias(right_key), F.get("distances", F.lit(0)).alias("distance"))


def nearest_in_group(df: DataFrame, group: list[str], key: str, coordinates: list[str], k: int) -> DataFrame:
    """Distances to the ``k`` nearest other rows of a group: (group, key, ranked array of distances). Rows alone in their group have none and give no row."""
    packed = df.withColumn("_g", F.to_json(F.struct(*group)))
    found = k_nearest(packed, packed, k, coordinates, "_g", key, key, apart=True).where(F.size("keys") > 0)
    return found.join(df.select(key, *group), key).select(*group, key, "distances")


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Edges (poly_id, ordinal, x1, y1, x2, y2) of polygons given as ``rings``: array of closed rings of [x, y]; holes are rings too."""
    rings = polygons.select("poly_id", "ordinal", F.explode("rings").alias("ring"))
    edge = rings.select("poly_id", "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.get("ring", i - 1).alias("a"), F.get("ring", i).alias("b")))).alias("e"))
    return edge.select("poly_id", "ordinal", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


#: Where in a cell its reference point stands, as shares of the side: off the round numbers that surveyed corners have.
_REFERENCE = (0.6180339887498949, 0.4142135623730951)


def polygon_cover(edges: DataFrame, size: float) -> DataFrame:
    """Cells of side ``size`` that polygons touch: (poly_id, ordinal, cx, cy, odd, edges). ``edges`` are those that pass through the cell, none in cells wholly inside.

    ``odd`` tells whether the cell's reference point is inside, by the parity of edges to its right. Rows of cells are filled between the cells that edges pass.
    """
    slack = size * 1e-9
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor((low - slack) / size), F.floor((high + slack) / size))))
    at = lambda y: F.col("x1") + F.coalesce(F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")), F.lit(0.0))
    bottom, top = (F.greatest(low, F.least(high, (F.col("cy") + d) * size)) for d in (0, 1))
    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, F.col("x1")).otherwise(at(bottom)), F.when(flat, F.col("x2")).otherwise(at(top))]
    wide = F.abs(F.col("x2") - F.col("x1")) * 1e-9 + slack
    passed = rows.withColumn("cx", F.explode(F.sequence(F.floor((F.least(*ends) - wide) / size), F.floor((F.greatest(*ends) + wide) / size))))
    rim = passed.groupBy("poly_id", "ordinal", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))

    in_row = Window.partitionBy("poly_id", "ordinal", "cy").orderBy("cx")
    cells = rim.withColumn("next", F.lead("cx").over(in_row)).withColumn("to", F.coalesce(F.col("next") - 1, F.col("cx")))
    parts = cells.select("poly_id", "ordinal", "cy", "cx", F.col("cx").alias("last"), "edges").unionByName(
        cells.where(F.col("to") > F.col("cx")).select("poly_id", "ordinal", "cy", (F.col("cx") + 1).alias("cx"), F.col("to").alias("last"), F.lit(None).cast(rim.schema["edges"].dataType).alias("edges"))
    )
    middle = (F.col("cy") + _REFERENCE[1]) * size
    crossing = rows.where((F.col("y1") > middle) != (F.col("y2") > middle)).select("poly_id", "ordinal", "cy", at(middle).alias("x"), F.lit(1).alias("turn"))
    asked = parts.withColumns({"x": (F.col("cx") + _REFERENCE[0]) * size, "turn": F.lit(0)})
    rightmost = Window.partitionBy("poly_id", "ordinal", "cy").orderBy(F.desc("x"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    told = asked.unionByName(crossing, allowMissingColumns=True).withColumn("odd", F.sum("turn").over(rightmost) % 2 == 1).where("turn = 0")
    kept = told.where("odd or edges is not null").withColumn("cx", F.explode(F.sequence("cx", "last")))
    return kept.select("poly_id", "ordinal", "cx", "cy", "odd", "edges")


def inside(points: DataFrame, edges: DataFrame, size: float, key: str = "point_id") -> DataFrame:
    """Pairs of points and polygons that hold them, by parity: (key, poly_id, ordinal).

    Points meet polygons in cells of side ``size``. A cell wholly inside answers at once; in a cell that edges pass, the way from the point to the cell's reference point, along its row and
    then up or down, crosses only edges of that cell, and each crossing changes sides. So a point tests no edge of another cell.
    """
    cover = polygon_cover(edges, size)
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    met = placed.join(cover, ["cx", "cy"]).withColumns({"rx": (F.col("cx") + _REFERENCE[0]) * size, "ry": (F.col("cy") + _REFERENCE[1]) * size})

    def along(e: Column) -> Column:
        at = F.try_divide((e["x2"] - e["x1"]) * (F.col("y") - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))) & ((F.col("x") < at) != (F.col("rx") < at))

    def across(e: Column) -> Column:
        at = F.try_divide((e["y2"] - e["y1"]) * (F.col("rx") - e["x1"]), e["x2"] - e["x1"]) + e["y1"]
        return ((e["x1"] > F.col("rx")) != (e["x2"] > F.col("rx"))) & ((F.col("y") < at) != (F.col("ry") < at))

    turns = F.when(F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", along)) + F.size(F.filter("edges", across)))
    return met.where((turns + F.col("odd").cast("int")) % 2 == 1).select(key, "poly_id", "ordinal")


def first_polygon(points: DataFrame, edges: DataFrame, strip: float, key: str = "point_id") -> DataFrame:
    """The first polygon, by ordinal, that holds each point; null if none."""
    hit = inside(points, edges, strip, key).groupBy(key).agg(F.min_by("poly_id", "ordinal").alias("poly_id"))
    return points.join(hit, key, "left")


def majority_polygon(points: DataFrame, edges: DataFrame, strip: float, group: str, least: int = 3, share: float = 0.5, key: str = "point_id") -> DataFrame:
    """For each group of points the polygon that holds most of them, if at least ``least`` and ``share`` of the located ones; ties to the first polygon."""
    located = points.where("x is not null and y is not null")
    total = located.groupBy(group).agg(F.count(F.lit(1)).alias("n_located"))
    hits = inside(located, edges, strip, key).join(located.select(key, group), key).groupBy(group, "poly_id", "ordinal").agg(F.count(F.lit(1)).alias("n_hits"))
    best = hits.groupBy(group).agg(F.max_by(F.struct("poly_id", "n_hits"), F.struct(F.col("n_hits"), (-F.col("ordinal")).alias("o"))).alias("b"))
    need = F.greatest(F.lit(float(least)), F.col("n_located") * share)
    ok = (F.col("n_located") >= least) & (F.col("b.n_hits") >= need)
    return total.join(best, group, "left").select(group, "n_located", F.coalesce(F.col("b.n_hits"), F.lit(0)).cast("long").alias("n_hits"), F.when(ok, F.col("b.poly_id")).alias("poly_id"))


def name_cascade(objects: DataFrame, sites: DataFrame, normal: Callable[[Column], Column], least: int = 5) -> DataFrame:
    """Site of each object by name: equality of keys with name or code, then the first site whose key of ``least`` letters is part of the object's.

    A key that is part of another shares all its runs of ``least`` letters with it, so containment is an equi join on each site's rarest run, then a test; any number
    of sites gives the same answer. Objects without a name, and sites without a key, match nothing.
    """
    o, s = objects.withColumn("_k", normal(F.col("name"))), sites.select("site_id", "ordinal", normal(F.col("name")).alias("_n"), normal(F.col("code")).alias("_c"))
    keys = s.select("site_id", "ordinal", F.explode(F.array("_n", "_c")).alias("_k")).where("_k <> ''").distinct()
    exact = o.where("_k <> ''").join(keys, "_k").groupBy("object_id").agg(F.min_by("site_id", "ordinal").alias("_exact"))

    def runs(key: str) -> Column:
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - least + 1), lambda i: F.substr(F.col(key), i, F.lit(least))))).alias("_run")

    named = s.where(F.length("_n") >= least).groupBy("_n").agg(F.min_by("site_id", "ordinal").alias("site_id"), F.min("ordinal").alias("ordinal"))
    parts = named.select("_n", runs("_n"))
    common = parts.groupBy("_run").agg(F.count(F.lit(1)).alias("_sites"))
    rarest = parts.join(common, "_run").groupBy("_n").agg(F.min(F.struct("_sites", "_run"))["_run"].alias("_run"))
    asked = o.where(F.length("_k") >= least).select("_k").distinct().select("_k", runs("_k"))
    pairs = asked.join(named.join(rarest, "_n"), "_run").where(F.col("_k").contains(F.col("_n")))
    first = pairs.groupBy("_k").agg(F.min_by("site_id", "ordinal").alias("_site"), F.min("ordinal").alias("_at"))
    part = o.join(first, "_k").groupBy("object_id").agg(F.min_by("_site", "_at").alias("_part"))
    joined = objects.join(exact, "object_id", "left").join(part, "object_id", "left")
    how = F.when(F.col("_exact").isNotNull(), "name").when(F.col("_part").isNotNull(), "contains").otherwise("none")
    return joined.select(*objects.columns, F.coalesce("_exact", "_part").alias("site_id"), how.alias("matched_by"))


def covering_tile(points: DataFrame, tiles: DataFrame, size: float, key: str = "point_id") -> DataFrame:
    """The last tile, by ordinal, whose extent [x0, x1) x [y0, y1) holds each point; null if none.

    Tiles and points meet on cells of ``size``, best about a tile's side: an equi join, whatever the tiles' extents.
    """
    cell = lambda c: F.floor(c / size).cast("long")
    dealt = tiles.where("x0 < x1 and y0 < y1").withColumn("_i", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("_j", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    asked = points.where("x is not null and y is not null").select(key, "x", "y", cell(F.col("x")).alias("_i"), cell(F.col("y")).alias("_j"))
    hits = asked.join(dealt, ["_i", "_j"]).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return points.join(hits.groupBy(key).agg(F.max_by("tile_id", "ordinal").alias("tile_id")), key, "left")


def site_cascade(objects: DataFrame, sites: DataFrame, points: DataFrame, edges: DataFrame, strip: float, normal: Callable[[Column], Column], create: bool = False) -> DataFrame:
    """Site of each object by its name, else by the polygon that holds most of its points, else, with ``create``, a new one by its name.

    ``points`` has object_id, point_id, x and y; poly_id of ``edges`` is the site. New sites have negative ids, a hash of the name's key, so one name makes one site;
    ``matched_by`` is name, contains, gps, created or none.
    """
    named = name_cascade(objects, sites, normal)
    placed = majority_polygon(points, edges, strip, "object_id").select("object_id", F.col("poly_id").cast("long").alias("_gps"))
    made = F.when(F.lit(create) & (F.coalesce(normal(F.col("name")), F.lit("")) != ""), -F.pmod(F.xxhash64(normal(F.col("name"))), F.lit(1 << 62)) - 1)
    site = F.coalesce(F.col("site_id").cast("long"), F.col("_gps"), made)
    how = F.when(F.col("matched_by") != "none", F.col("matched_by")).when(F.col("_gps").isNotNull(), "gps").when(made.isNotNull(), "created").otherwise("none")
    return named.join(placed, "object_id", "left").select(*objects.columns, site.alias("site_id"), how.alias("matched_by"))

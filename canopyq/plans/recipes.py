"""Projections of the star schema onto the engine's inputs, as SQL that Spark and the oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Projection name -> (table, select list); every expression means the same in both dialects.
RECIPES: dict[str, tuple[str, str]] = {
    "points": ("lineitem", "l_extendedprice / 100 AS x, l_quantity * 20 AS y, l_discount * 100 + l_tax * 100 AS z, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS classification"),
    "spots": ("customer", "c_custkey AS point_id, (c_custkey * 7919) % 1000 * 1e0 + 5e-1 AS x, (c_custkey * 104729) % 997 * 1e0 + 2.5e-1 AS y, c_acctbal AS z, CAST(c_nationkey AS BIGINT) AS grp"),
    "ground": ("supplier", "s_suppkey AS ground_id, (s_suppkey * 6151) % 1000 * 1e0 AS x, (s_suppkey * 3571) % 997 * 1e0 AS y"),
    "trees": (
        "part",
        "p_partkey AS tree_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 8e0 + p_size * 5e-1 END AS height_m, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 6e0 + (p_retailprice - 900) * 4e-1 END AS dbh_cm, "
        "CASE WHEN p_partkey % 13 = 0 THEN 'dbh_unsupported' ELSE 'good' END AS dbh_status, (p_partkey % 10) / 1e1 AS dbh_confidence, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_partkey % 5 END AS compartment",
    ),
    "slices": (
        "lineitem",
        "l_orderkey AS tree_id, l_linenumber * 4e-1 + l_quantity * 1e-3 AS z_mid, 2e-2 + l_extendedprice / 1e6 AS radius_m, l_discount AS cx, l_tax AS cy, l_quantity * 7e0 AS coverage_deg, l_discount AS residual_m, l_tax AS interior_ratio, "
        "l_partkey % 14 AS n_points, l_suppkey AS tie",
    ),
    "files": ("events", "CAST(event_id AS STRING) AS file_name, user_id AS object_id, event_type AS machine, ts AS file_time, CAST(floor(value * 100 + 0.5) AS BIGINT) AS volume_cm3"),
    "stems": (
        "orders",
        "o_custkey % 25 AS object_id, o_orderkey AS stem_key, o_totalprice / 1e5 AS stem_volume_m3, o_custkey % 40 + 8e0 AS dbh_cm, 50e0 + (o_orderkey % 1000) / 1e4 AS lat, -3e0 + (o_custkey % 1000) / 1e4 AS lon, "
        "(o_orderkey % 300) / 1e1 AS canopy_m, 3e0 + (o_orderkey % 17) * 5e-2 AS log_cycle",
    ),
}

#: Polygons of the same literals in both engines: (poly_id, ordinal, rings).
POLYGONS: list[tuple[int, int, list[list[list[float]]]]] = [
    (1, 1, [[[50.0, 50.0], [450.0, 80.0], [300.0, 300.0], [420.0, 480.0], [60.0, 450.0], [50.0, 50.0]], [[150.0, 150.0], [250.0, 150.0], [200.0, 250.0], [150.0, 150.0]]]),
    (2, 2, [[[250.0, 250.0], [900.0, 200.0], [850.0, 700.0], [500.0, 500.0], [250.0, 250.0]]]),
    (3, 3, [[[100.0, 600.0], [700.0, 620.0], [650.0, 950.0], [120.0, 900.0], [100.0, 600.0]]]),
]


def recipe(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, select = RECIPES[name]
    return spark.sql(f"SELECT {select} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def oracle_recipe(name: str) -> str:
    """The same projection as a parenthesised subquery."""
    table, select = RECIPES[name]
    return f"(SELECT {select} FROM {table})"


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLYGONS, "poly_id int, ordinal int, rings array<array<array<double>>>")


def oracle_edges() -> str:
    rows = [f"({p}, {o}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for p, o, rings in POLYGONS for ring in rings for a, b in zip(ring[:-1], ring[1:], strict=True)]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS e(poly_id, ordinal, x1, y1, x2, y2))"

"""Every registered query with SQL must give the oracle's rows on the smallest tables; those without must run."""

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

from canopyq.plans import catalog, catalog_clouds  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    """Rows as comparable tuples; doubles to nine significant digits."""

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}" if v else "0"
        return str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    index = [want.columns.index(c) for c in columns]
    assert plain(got) == plain(tuple(float(r[i]) if type(r[i]).__name__ == "float32" else r[i] for i in index) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    path = Path(__file__).resolve().parents[2] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())

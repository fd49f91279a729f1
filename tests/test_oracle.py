"""Every query against its SQL on the smallest tables, and those with rounding ties or many rows on larger ones."""

import glob
import os

import duckdb
import pytest

from polargrain.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr([plain(v) for v in r]) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    want = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)
    assert [str(got.schema.field(n).type) for n in sorted(got.column_names)] == [str(want.schema.field(n).type) for n in sorted(want.column_names)]


LARGER = ("cloud_two_sequences", "grid_cells", "grid_delta_events", "grid_neighbor_slope", "perf_rolling_100", "perf_rolling_all", "range_image_nearest", "range_recovery", "segmentation_loss", "step_rates", "vote_3x3")


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_sql_on_larger_tables(spark, sf_dir, name):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for f in glob.glob(f"{larger}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(registry.QUERIES[name](spark, larger).toArrow()) == rows(con.sql(registry.ORACLE_SQL[name]).to_arrow_table())


def test_entry_and_guard(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every geographic query against its SQL, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from terragrain.plans import catalogue

SF = "/root/testdata/sf0.001"


#: Tables of few rows show too little at the smallest size.
LARGER = "/root/testdata/sf0.01"
FEW_ROWS = {"boundary_on_sphere", "zone_rings", "dissolved_zones", "state_dimension"}


def connect(folder):
    con = duckdb.connect()
    for name in ("nation", "supplier", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def con():
    return {folder: connect(folder) for folder in (SF, LARGER)}


def plain(table, columns):
    return sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in table[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    folder = LARGER if name in FEW_ROWS else SF
    got, wanted = catalogue.QUERIES[name](spark, folder).toPandas(), con[folder].sql(catalogue.SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(wanted, columns)


def test_entry_and_registration(spark):
    assert driver.entry(spark).count() == 30
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(catalogue.QUERIES) <= set(driver.queries())
    if os.path.isdir(os.path.join(os.path.dirname(driver.__file__), "terragrain", "llm")):
        assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in driver.queries()}

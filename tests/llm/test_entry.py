"""The registered queries against their SQL, over the small generated tables."""

import duckdb
import pandas as pd
import pytest

from terragrain.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(table, columns):
    # Whole numbers beside nulls come as floats from one side.
    value = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(map(value, r))) for r in table[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_equals_sql(spark, con, name):
    got, wanted = entry.QUERIES[name](spark, SF).toPandas(), con.sql(entry.SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(wanted, columns)

"""Queries of the subpackage against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from framewright.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    want, got = con.execute(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert as_text(got).equals(as_text(want))

"""Every query against its SQL in DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from framewright.plans import queries
from framewright.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, db, name):
    want, got = db.execute(SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    as_text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert as_text(got).equals(as_text(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_random_forest_takes_every_window(spark, sf, db, monkeypatch):
    seen = []
    train = queries.models.train
    monkeypatch.setattr(queries.models, "train", lambda name, df, *a, **b: (seen.append(df.count()), train(name, df, *a, **b))[1])
    tested = QUERIES["random_forest_metrics"](spark, sf).first()["support"]
    sql = """SELECT sum(greatest(n - 9, 0)) FROM (SELECT user_id, event_id % 3, count(*) AS n FROM events WHERE ((user_id * 7) % 60) // 12 + 1 IN {} GROUP BY ALL)"""
    assert seen == [db.execute(sql.format("(1, 2, 3)")).fetchone()[0]] and tested == db.execute(sql.format("(4)")).fetchone()[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

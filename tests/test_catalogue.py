import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table in ("lineitem", "supplier", "customer", "orders", "part", "events", "nation", "region"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.sql(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(str).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() == 10

"""Driver contract: entry() runs, and every registered query equals its
DuckDB oracle on the smallest test data."""
import duckdb
import pytest

import __spark_entry__ as e
from scripts.compare import TABLES, rows_of
from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["file_id", "repo", "path", "step"]


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = e.queries()[name](spark, SF_SMALL).toPandas()
    ddf = duck.execute(e.oracle_sql()[name]).df()
    assert rows_of(sdf) == rows_of(ddf)

"""Every registered query against its SQL in DuckDB, and the driver's contract."""

import duckdb
import pytest

from ledgerspark.plans import all_queries
from tests.conftest import SMALL, table

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries.queries()))
def test_query(spark, duck, name):
    df = all_queries.queries()[name](spark, SMALL)
    rows = df.collect()
    sql = all_queries.oracle_sql().get(name)
    if sql is not None:
        q = duck.sql(sql)
        assert table([tuple(r) for r in rows], df.columns) == table(q.fetchall(), q.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

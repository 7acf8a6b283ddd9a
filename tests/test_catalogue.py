import duckdb
import pandas as pd
import pytest

from orrery import catalogue, plans

SF = "/root/testdata/sf0.01"


QUERIES = catalogue.QUERIES | plans.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | plans.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    mine = QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for table in ("embeddings", "part", "orders", "events", "customer", "documents", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    other = db.sql(ORACLE_SQL[name]).df()
    assert len(other) > 0
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    mine, other = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, other))
    pd.testing.assert_frame_equal(mine, other, check_dtype=False)

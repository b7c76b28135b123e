"""Every registered query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from docgate.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)

"""Every query with SQL, beside DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from keyorder.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


def rows(columns, found):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in at) for r in found)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())

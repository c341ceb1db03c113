"""Every query with SQL gives the rows of that SQL; the others run."""

import os

import duckdb
import pytest

from eventloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name in queries.SQL:
        names = ", ".join(f'"{c}"' for c in columns)
        assert plain(rows) == plain(duck.execute(f"SELECT {names} FROM ({queries.SQL[name]})").fetchall())
    else:
        assert rows or name in ("merged_sorting", "communities")

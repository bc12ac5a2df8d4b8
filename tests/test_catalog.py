"""Every query of the catalogue against its SQL, in DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from waymark.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in catalog.ORACLE_SQL:
        cur = db.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(got.columns) == sorted(names)
        assert rows_of(got.columns, rows) == rows_of(names, cur.fetchall())

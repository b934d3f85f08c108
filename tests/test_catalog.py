"""Every query against its SQL, over whole tables."""

import duckdb
import pytest

from contractlog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("none" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.collect() is not None
        return
    want = duck.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = plain(got.select(*cols).collect())
    theirs = plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert len(mine) == len(theirs) and mine == theirs

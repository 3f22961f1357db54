"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from newsloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def flat(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, D)
    if name not in catalogue.oracle_sql():
        assert got.count() > 0
        return
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert flat(got.columns, got.collect()) == flat(names, want.fetchall())

"""Every registered query against its SQL."""

import math
import os

import pytest

from lexmere.oracles import ORACLES
from lexmere.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def key(row):
    return repr(["NaN" if isinstance(v, float) and math.isnan(v) else v for v in row])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(key(r) for r in df.select(*names).collect())
    assert got == sorted(key(r) for r in cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)

"""Every registered corpus query that SQL can express, against its SQL."""

import os

import pytest

from lexmere.llm.oracles import ORACLES
from lexmere.llm.queries import QUERIES
from tests.test_queries import SF, con, key  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)

    def rows(found):  # mean scores are quotients of whole numbers on both sides
        return sorted(key([round(v, 9) if isinstance(v, float) else v for v in r]) for r in found)

    assert rows(df.select(*names).collect()) == rows(cursor.fetchall())

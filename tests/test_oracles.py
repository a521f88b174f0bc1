"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerloom import plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.7f}" if not isinstance(v, str) else v

    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_query(spark, duck, name):
    found = plans.queries()[name](spark, DIR)
    want = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_other_query_runs(spark, name):
    assert plans.queries()[name](spark, DIR).count() > 0

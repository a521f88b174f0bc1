"""The driver's contract."""

import __spark_entry__ as entry
from ledgerloom import plans


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(plans.queries()) <= set(queries)
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) and s.strip() for s in sql.values())


def test_every_query_says_what_it_does():
    assert all((q.__doc__ or "").strip() for q in plans.queries().values())

"""Every query against its SQL, on the smallest tables."""

import pytest

from conftest import SMALL, alike, rows_of
from weftline import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
#: SQL does not fold hashes level by level; test_memo_hash.py has a plain recursion.
WITHOUT_SQL = {"gr_memo_hash"}
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SMALL)
    names, found = rows_of(df)
    wanted_names, kinds, wanted = oracle(ORACLES[name])
    assert names == wanted_names
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    assert alike(found) == alike(wanted)


def test_all_others_have_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

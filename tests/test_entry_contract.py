"""The driver contract of __spark_entry__."""

import re

import __spark_entry__ as E


def test_oracle_keys_are_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    assert all(callable(f) for f in q.values())


def test_query_names_are_plain():
    for name in E.queries():
        assert re.fullmatch(r"[a-z0-9_]+", name)


def test_entry_schema_is_stable(spark):
    a = E.entry(spark).schema.simpleString()
    b = E.entry(spark).schema.simpleString()
    assert a == b == "struct<item1:bigint,item2:bigint,score:double,rank:bigint>"

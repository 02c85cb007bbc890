"""Every query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest

from claimstone import catalogue
from tests.compare import duck_rows, spark_rows


#: Queries that find nothing in smaller tables.
LARGER = {"similar_vectors_capped": "/root/testdata/sf0.1"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    sf_dir = LARGER.get(name, sf_dir)
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = spark_rows(df)
    if name in catalogue.SQL:
        columns, want = duck_rows(duck, catalogue.SQL[name])
        assert sorted(df.columns) == sorted(columns)
        assert got == want
    else:
        assert got


def test_sql_names_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

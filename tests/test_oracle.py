"""Every registered query against its SQL, on the smallest tables."""

import pytest

from matchloom.plans import all_oracles, all_queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows_as_sql(spark, con, name):
    same, note = compare(spark, con, all_queries()[name], all_oracles()[name], SF_DIR)
    assert same, note


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "item_id", "role", "score"]
    assert df.count() == 200

"""Every registered query against its comparison SQL."""

import compare
import pytest

import __spark_entry__ as entry
from conftest import DATA

QUERIES, ORACLES = entry.QUERIES, entry.ORACLES  # the corpus operators have their own tests


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    verdict, n, _ = compare.compare(spark, con, DATA, QUERIES[key], ORACLES.get(key))
    assert verdict in ("ok", "rows only")
    assert n >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["status", "amount"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)

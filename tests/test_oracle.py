"""Every registered query against its DuckDB counterpart, on whole tables."""

import pytest

import __spark_entry__ as entry
import oracle_check
from fleetlark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    result = entry.queries()[name](spark, sf)
    assert oracle_check.differences(result, duck, entry.oracle_sql()[name]) is None


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 525

"""Each registered query gives the rows of its SQL."""

import os

import pytest

from tessera import catalog
from tests.compare import both

FOLDER = os.environ.get("TEST_FOLDER", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert catalog.queries()[name](spark, FOLDER).columns
        return
    got, want = both(spark, FOLDER, catalog.queries()[name], sql)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert [x for x in zip(got[1], want[1], strict=True) if x[0] != x[1]][:3] == []

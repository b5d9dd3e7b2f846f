"""Every query against its SQL, on the whole tables."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as contract
from flowlens.catalog.oracle import ORACLE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    _, difference = compare(contract.queries()[name](spark, FOLDER), con, ORACLE[name])
    assert difference is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 25

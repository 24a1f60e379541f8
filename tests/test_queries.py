import os

import pytest

from usagelens_checks.compare import difference, duck
from usagelens_checks.oracle import ORACLE
from usagelens_checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, connection, name):
    assert difference(spark, connection, name, SF_DIR) == ""


def test_entry(spark):
    import __spark_entry__ as contract

    frame = contract.entry(spark)
    assert frame.columns == ["day", "username", "reqs", "io", "cost_micros"] and frame.count() > 0
    # Every query of the library has a twin; those on training text have one where SQL can express them.
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())

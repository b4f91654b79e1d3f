"""Every registered query against its SQL, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()

#: Queries that find nothing in the smallest tables: no notebook there is broken.
EMPTY = {"notebook_file_rejects"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


# Models are trained in test_learning.
@pytest.mark.parametrize("name", [n for n in entry.queries() if n in ORACLES])
def test_query(spark, connection, name):
    problem = compare(entry.queries()[name](spark, SF_DIR), ORACLES[name], connection)
    assert problem is None or (problem == "no rows" and name in EMPTY), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLES) <= set(entry.queries())

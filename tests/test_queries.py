"""Every registered query against its check SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The text operators have tests of their own where they are installed.
QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in CHECKS:
        assert compare(df, con, CHECKS[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "segment"

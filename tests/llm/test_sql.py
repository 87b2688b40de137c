"""The queries that SQL can express, against it."""

import pytest

from newsloom.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")

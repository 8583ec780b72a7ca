"""Corpus queries against the SQL that can say them."""

import pytest

from levelloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problem, rows = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert problem is None and rows > 0, problem

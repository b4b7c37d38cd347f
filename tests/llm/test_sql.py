"""The queries of the subpackage against their SQL."""

import pytest

from helispan.llm import queries
from tests.oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert compare(queries.queries()[name](spark, SF_DIR), queries.oracle_sql()[name]) > 0

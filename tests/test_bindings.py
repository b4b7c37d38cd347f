"""Every query of the library's own operators against its SQL."""

import pytest

from helispan.plans import bindings
from tests.oracle import SF_DIR, compare

QUERIES, SQL = bindings.queries(), bindings.oracle_sql()
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, SQL[name]) > 0
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["relative_angles", "three_axes_angles", "exact_matching", "packed_matrices"])
def test_query_on_more_rows(spark, name):
    """Rows of the larger table that the smaller one lacks: axes that nearly meet, more matrices."""
    assert compare(QUERIES[name](spark, LARGER), SQL[name], LARGER) > 0

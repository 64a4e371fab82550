"""Every registered query against its SQL on the small tables."""

import pytest

from finfacts.checks.catalog import ORACLES, QUERIES
from finfacts.checks.compare import difference

# A query may have no rows at the smallest scale.
EMPTY_OK = {"no rows on either side"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, sf_dir, name):
    assert name in ORACLES
    problem = difference(spark, oracle, name, QUERIES[name], ORACLES[name], sf_dir)
    assert problem is None or problem in EMPTY_OK, problem

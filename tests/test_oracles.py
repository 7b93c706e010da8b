import pytest
from oracle import compare

from keyloom.plans.registry import ORACLES, QUERIES

#: Audits that find no offender in the given tables; their operators are tested on tables with offenders.
CLEAN = {"subset_orphans"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) > 0 or name in CLEAN

import pytest
from oracle import compare

from keyloom.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) > 0

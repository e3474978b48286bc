import pytest

from ticketloom.llm import catalog
from tests.duck import compare, connect


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql_twin(spark, sf, name):
    assert compare(spark, connect(sf), catalog.QUERIES[name], catalog.ORACLES[name], sf) is None

import pytest

from kelpwright.llm.queries import registry
from tests.parity import DATA, compare

SMALL = DATA / "sf0.001"


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", registry.queries)
def test_parity(spark, name):
    if name in registry.oracles:
        assert compare(spark, name, registry.queries[name], registry.oracles[name], str(SMALL)) is None
    else:
        registry.queries[name](spark, str(SMALL)).collect()

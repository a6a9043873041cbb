"""Every query of the core with oracle SQL agrees with it on the small tables."""

import importlib

import pytest

from tests.parity import DATA, compare

SMALL = DATA / "sf0.001"
MODULES = [importlib.import_module(f"kelpwright.plans.{m}").registry for m in ("problems", "foundation", "analysis", "models", "protocol")]
CASES = [(name, q, r.oracles.get(name)) for r in MODULES for name, q in r.queries.items()]


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_parity(spark, name, query, sql):
    if sql is None:
        assert query(spark, str(SMALL)).count() > 0
    else:
        assert compare(spark, name, query, sql, str(SMALL)) is None

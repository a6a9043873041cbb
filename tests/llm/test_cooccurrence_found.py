from kelpwright.llm import cooccurrence
from kelpwright.llm.queries import p7_found
from tests.parity import DATA


def test_found_pairs_come_from_the_tested_ones(spark, monkeypatch):
    fitted = []
    fit = cooccurrence.fit_configuration

    def counted(*args):
        fitted.append(args)
        return fit(*args)

    monkeypatch.setattr(cooccurrence, "fit_configuration", counted)
    found = p7_found(spark, str(DATA / "sf0.001"))
    assert found.columns == ["item_a", "item_b"] and len(fitted) == 1

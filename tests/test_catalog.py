import numpy as np
import pytest

from kelpwright.arrays import open_arrays
from kelpwright.operators import catalog


def best(p, q, seen, n):
    """{user: item ids} by scoring everything."""
    out = {}
    for u, v in enumerate(p):
        score = np.round(q @ v, 9)
        able = [i for i in np.lexsort((np.arange(len(q)), -score)).tolist() if (u, i) not in seen and np.isfinite(score[i])]
        out[u] = able[:n]
    return out


def lists_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["u"], r["rank"])):
        out.setdefault(r["u"], []).append(r["i"])
    return out


@pytest.mark.parametrize("shape", ["any", "ties", "few", "busy"])
def test_catalog_lists_equal_scoring_everything(spark, monkeypatch, shape):
    rng = np.random.default_rng(51)
    monkeypatch.setattr(catalog, "FILE_ITEMS", 300)
    n_items = 6 if shape == "few" else 900
    p, q = rng.normal(size=(20, 3)), rng.normal(size=(n_items, 3)) + 0.5
    if shape == "ties":
        p, q = np.round(p), np.round(q)
    p[3], q[min(4, n_items - 1)] = 0, [np.nan, 1, np.inf]
    seen = {(u, int(i)) for u in range(1, 20) for i in rng.integers(0, n_items, 8)}
    if shape == "busy":  # one user has seen the whole catalog, one all but three items
        seen |= {(1, i) for i in range(n_items)} | {(2, i) for i in range(n_items - 3)}
    own = [(u, p[u].tolist(), [i for w, i in sorted(seen) if w == u]) for u in range(20)] + [(20, [float("nan"), 1.0, 1.0], [])]
    users = spark.createDataFrame(own, "u int, v array<double>, seen array<bigint>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "i int, v array<double>")
    with np.errstate(invalid="ignore"):
        want = {u: items for u, items in best(p, q, seen, 5).items() if items}
    assert lists_of(catalog.catalog_lists(users, items, "u", "i", 5)) == want
    assert catalog.catalog_lists(users, items.limit(0), "u", "i", 5).count() == 0


def test_most_of_a_catalog_is_never_scored(monkeypatch, tmp_path):
    rng = np.random.default_rng(52)
    p, q = rng.normal(size=(200, 4)), rng.normal(size=(40_000, 4))
    laid = catalog.pa.RecordBatch.from_arrays([catalog.pa.array(range(len(q))), catalog.pa.array(q.tolist())], names=["i", "v"])
    file = next(catalog._laid_out(f"file://{tmp_path}", "i", catalog.CELL)(iter([laid])))["file"][0].as_py()
    scored = []

    class Counted(catalog._Lists):
        def _visit(self, users, cell, c, slack):
            scored.append(len(users) * catalog.CELL)
            super()._visit(users, cell, c, slack)

    lists = Counted(p, np.zeros(0, int), np.zeros(0, int), 10)
    lists.meet(open_arrays(file))
    got = {u: lists.near[lists.row == u].tolist() for u in range(200)}
    assert got == best(p, q, set(), 10)
    assert sum(scored) < 0.1 * len(p) * len(q)

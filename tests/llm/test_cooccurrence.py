import itertools
import math
import random
import tempfile
from collections import Counter

import numpy as np

from kelpwright.llm.cooccurrence import cooccurring_pairs, fit_configuration, log10_tail


def exact_tail(q, trials, n):
    p = np.array([1.0])
    for prob, t in zip(q, trials, strict=True):
        for _ in range(int(t)):
            p = np.convolve(p, [1 - prob, prob])
    return math.log10(p[n:].sum())


def test_tail_is_that_of_the_poisson_binomial():
    trials = np.array([50.0, 30, 20])
    q = np.array([[0.05, 0.2, 0.01], [0.3, 0.1, 0.2]])
    for n in (1, 5, 9, 15, 25, 40, 60, 99):
        got = log10_tail(q, trials, np.array([n, n]))
        for k in range(2):
            assert abs(got[k] - exact_tail(q[k], trials, n)) < 0.02 + 0.002 * abs(got[k])


def test_fit_keeps_frequencies_and_sizes():
    freq, items, size, records = np.array([1, 5, 25]), np.array([50, 10, 2]), np.array([1, 2, 5]), np.array([50, 25, 10])
    x, y = fit_configuration(freq, items, size, records)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * records).sum(1), freq, rtol=1e-6)
    assert np.allclose((p * items[:, None]).sum(0), size, rtol=1e-6)


SCHEMA = "r string, items array<long>, item_a string"


def run(spark, rows, **kw):
    return cooccurring_pairs(spark.createDataFrame(rows, SCHEMA), "r", "items", **kw)


def test_counts_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"r{k}", rng.choice([None, []] + [[rng.choice([None, *range(12)]) for _ in range(rng.randint(1, 9))] for _ in range(8)]), None) for k in range(300)]
    rows += rows[:60] + [(None, [1, 2], "")]
    sets = {}
    for r, items, _ in rows:
        own = sorted({i for i in items or [] if i is not None})
        if r is not None and own:
            sets[r] = own
    single, pair = Counter(), Counter()
    for own in sets.values():
        single.update(own)
        pair.update(itertools.combinations(own, 2))
    got = {(r.item_a, r.item_b): r for r in run(spark, rows, min_count=2).collect()}
    assert {k: r.n_ab for k, r in got.items()} == {k: n for k, n in pair.items() if n >= 2}
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (single[a], single[b], len(sets))
        assert abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9 and r.log10_p <= 0


def test_a_planted_pair_is_significant_and_chance_is_not(spark):
    rng = random.Random(9)
    rows = [(f"r{k}", [rng.randrange(100) for _ in range(6)], None) for k in range(2000)]
    rows += [(f"s{k}", [500, 501, rng.randrange(100)], None) for k in range(30)]
    found = {(r.item_a, r.item_b) for r in run(spark, rows, min_count=3).where("significant").collect()}
    assert (500, 501) in found and len(found) <= 3


def test_rare_pairs_are_tested_whatever_is_put_out(spark):
    rows = [(f"r{k}-{j}", [1000 + 2 * k, 1001 + 2 * k], None) for k in range(200) for j in range(3)]
    rows += [(f"xy{k}", [1, 2], None) for k in range(7)]
    rows += [(f"x{k}", [1, 5000 + k], None) for k in range(13)] + [(f"y{k}", [2, 6000 + k], None) for k in range(13)]
    full = {(r.item_a, r.item_b): r for r in run(spark, rows).collect()}
    assert full[1000, 1001].n_ab == 3 and full[1000, 1001].significant and full[1, 2].significant
    cut = {(r.item_a, r.item_b): r for r in run(spark, rows, min_count=5).collect()}
    assert cut == {k: r for k, r in full.items() if r.n_ab >= 5}


def test_the_registered_query_has_every_pair(spark):
    from kelpwright.llm.queries import registry

    rows = spark.createDataFrame([(f"r{k}", [1, 2, 10 + k]) for k in range(4)], "request_id string, history_item_ids array<long>")
    with tempfile.TemporaryDirectory() as d:
        rows.write.parquet(f"{d}/validation.parquet")
        got = {(r.item_a, r.item_b): r.n_ab for r in registry.queries["p7_surprise"](spark, d).collect()}
    assert got == {(1, 2): 4} | {(i, 10 + k): 1 for i in (1, 2) for k in range(4)}


def test_a_record_logged_with_different_lists_has_all_items(spark):
    got = run(spark, [("a", [1, 2], None), ("a", [3, None], None), ("b", [3], None)]).collect()
    assert sorted((r.item_a, r.item_b, r.n_ab, r.n) for r in got) == [(1, 2, 1, 2), (1, 3, 1, 2), (2, 3, 1, 2)]


def test_empty(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [("a", None, ""), ("b", [], ""), ("c", [None], ""), ("d", [1], "")]).collect() == []

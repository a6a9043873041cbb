"""Hand-checked values of the operators' rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwright.functions import scalars as S
from kelpwright.operators import baselines, checks, cleaning, dedup, encode, factor, history, kcore, metrics, neighborhood, profile, select, split, towers, vectors


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


EVENTS = "request_id string, user_id long, item_id long, request_time_ms long, long_view boolean, is_random boolean"


def test_prior_history_against_brute_force(spark):
    rng = random.Random(21)
    data = [(f"q{k:03}", rng.randrange(4), 500 + k, rng.randrange(25), rng.random() < 0.7, rng.random() < 0.2) for k in range(160)]
    got = dict(rows(history.prior_histories(cleaning.positive_events(spark.createDataFrame(data, EVENTS)), 6), "request_id", "history_item_ids"))
    liked = sorted((u, t, q, i) for q, u, i, t, view, drawn in data if view and not drawn)
    assert got == {q: [i for v, s, _, i in liked if v == u and s < t][-6:] for u, t, q, _ in liked}


def test_completed_history_against_brute_force(spark):
    rng = random.Random(22)
    data, schema = [], "user_id long, item_id long, time_ms long, available_ms long, ordinal long"
    for u in range(5):
        times = sorted(rng.randrange(60) for _ in range(40))
        data += [(u, rng.randrange(9), t, t + rng.choice([0, 1, 4, 30, 200]), n) for n, t in enumerate(times)]
    got = {(u, n): h for u, n, h in rows(history.completed_histories(spark.createDataFrame(data, schema), 4), "user_id", "ordinal", "history_item_ids")}
    assert got == {(u, n): [i for v, i, _, ready, m in sorted(data, key=lambda r: r[4]) if v == u and ready < t][-4:] for u, _, t, _, n in data}


def test_time_windows(spark):
    df = spark.createDataFrame([(9, False), (10, False), (19, False), (20, False), (20, True), (31, False), (None, False), (None, True)], "t long, r boolean")
    got = rows(split.time_window_split(df, [("first", 10), ("second", 20), ("third", 31)], "rest", "t", "r"), "split")
    assert [x for (x,) in got][:6] == ["first", "second", "second", "third", "random", "rest"]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_exact_top_k_against_brute_force(spark, metric):
    rng = np.random.default_rng(23)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[5] = v[17]
    since, kind = rng.integers(0, 30, 60), rng.integers(0, 3, 60)
    held = spark.createDataFrame([(int(i), v[i].tolist(), int(since[i]), int(kind[i])) for i in range(60)] + [(70, None, 0, 0), (None, v[0].tolist(), 0, 0)], "idx long, v array<double>, e long, g int")
    asked = held.where("idx % 7 = 0").withColumn("at", F.lit(15).cast("long"))
    got = vectors.exact_top_k(asked, held, 3, metric, group="g", time="at", eligible="e")
    size = np.linalg.norm(v, axis=1)
    score = {"dot": v @ v.T, "cosine": v @ v.T / np.outer(size, size), "euclidean": -np.linalg.norm(v[:, None] - v[None], axis=2)}[metric]
    want = {}
    for q in range(0, 60, 7):
        ok = [i for i in range(60) if i != q and since[i] <= 15 and kind[i] == kind[q]]
        want[q] = sorted(ok, key=lambda i: (-round(score[q, i], 9), i))[:3]
    lists = {}
    for q, i, r in sorted(rows(got, "query", "neighbor", "rank"), key=lambda x: (x[0], x[2])):
        lists.setdefault(q, []).append(i)
    assert lists == {q: own for q, own in want.items() if own}
    padded = dict(rows(vectors.padded_lists(got, asked.where("idx IS NOT NULL"), "idx", 3), "query", "neighbors"))
    assert all(padded[q] == own + [-1] * (3 - len(own)) for q, own in want.items())


def test_single_target_and_decomposition(spark):
    df = spark.createDataFrame([(1, True), (2, True), (None, False)], "rank int, covered boolean")
    r = metrics.single_target_metrics(df, 3).first()
    assert (r.recall, r.covered_recall, r.coverage) == (2 / 3, 1.0, 2 / 3) and abs(r.ndcg - (1 + 1 / math.log2(3)) / 3) < 1e-12
    assert metrics.single_target_metrics(df.limit(0), 3).first().recall is None
    assert tuple(metrics.coverage_decomposition(df, 3).first()) == (1, 0, 2)


def test_rank_by_counting_against_sorting(spark):
    rng = random.Random(24)
    data = [(q, i, float(rng.randrange(4)), (q * 5) % 11) for q in range(6) for i in range(11)]
    df = spark.createDataFrame(data, "q int, i int, s double, target int")
    want = {q: sorted(range(11), key=lambda i: (-data[q * 11 + i][2], i)).index((q * 5) % 11) + 1 for q in range(6)}
    assert dict(rows(metrics.rank_by_counting(df, "q", "s", "i", "target"), "q", "rank")) == want


def test_user_metrics_against_their_definitions(spark):
    rng = random.Random(25)
    lists = {u: rng.sample(range(12), 5) for u in range(8)}
    liked = {u: set(rng.sample(range(12), rng.randint(1, 7))) for u in range(9)}
    recs = spark.createDataFrame([(u, i, r) for u, own in lists.items() for r, i in enumerate(own, 1)], "user_id int, item_id int, rank int")
    truth = spark.createDataFrame([(u, i) for u, own in liked.items() for i in own], "user_id int, item_id int")
    got = {r.user_id: r for r in metrics.user_ranking_metrics(recs, truth, 4).collect()}
    for u, own in liked.items():
        hits = [i in own for i in lists.get(u, [])[:4]]
        gain = sum(h / math.log2(r + 1) for r, h in enumerate(hits, 1))
        best = sum(1 / math.log2(r + 1) for r in range(1, min(4, len(own)) + 1))
        assert (got[u].hit, got[u].precision, got[u].recall) == (int(any(hits)), sum(hits) / 4, sum(hits) / len(own))
        assert abs(got[u].ndcg - gain / best) < 1e-12


def test_rating_errors_clip_and_skip_unrated(spark):
    df = spark.createDataFrame([(4, 6.5), (0, 1.0), (2, 0.25), (3, 3.5)], "a int, p double")
    r = metrics.rating_errors(df, "a", "p").first()  # errors 1 (clipped to 5), none, -1 (to 1), 0.5
    assert (r.n, r.mae) == (3, 2.5 / 3) and abs(r.rmse - math.sqrt(2.25 / 3)) < 1e-12


def test_cleaning_and_best_record(spark):
    raw = [
        ("u1", "b1", "4", "True", "False", "Mon Jan 01 00:00:00 -0700 2017"), ("u1", " b1 ", "5", "1", "yes", "Tue Jan 02 00:00:00 -0700 2017"),
        ("", "b2", "4", "", "", "2017-01-01"), ("u2", "b2", "8", "", "", "2017-01-01"), ("u2", "b3", "3", None, None, ""), ("u3", "b9", "x", None, None, "2017-01-01"),
    ]
    df = cleaning.clean_interactions(spark.createDataFrame(raw, "user_id string, book_id string, rating string, is_read string, is_reviewed string, date_updated string"))
    assert df.count() == 2
    best = dedup.best_record(df, ["user_id", "item_id"], [F.desc("information_score"), F.desc("event_time")]).first()
    assert (best.rating, best.is_reviewed, best.information_score, str(best.event_time)) == (5, True, 3, "2017-01-02 07:00:00")


def test_k_core_against_brute_force(spark):
    rng = random.Random(26)
    data = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(130)})
    data = [(u, i, rng.randrange(3), f"{u}/{i}") for u, i in data]
    kept = data
    while True:
        before = len(kept)
        for side, least, rated in ((0, 3, 1), (1, 2, 1)):
            own = {}
            for r in kept:
                own.setdefault(r[side], []).append(r[2] > 0)
            kept = [r for r in kept if len(own[r[side]]) >= least and sum(own[r[side]]) >= rated]
        if len(kept) == before:
            break
    df = spark.createDataFrame(data, "user_id int, item_id int, rating int, note string")
    assert 0 < len(kept) < len(data)
    assert sorted(rows(kcore.iterative_k_core(df, 3, 1, 2, 1), *df.columns)) == kept
    assert kcore.iterative_k_core(df.limit(0), 2, 1, 2, 1).count() == 0


def test_ids_are_numbered_in_the_order_of_their_text(spark):
    df = spark.createDataFrame([(9, "mm"), (80, "b"), (80, "B"), (700, None), (None, "b")], "n int, s string")
    assert dict(rows(encode.encode_ids(df, "n", "x"), "n", "x")) == {700: 0, 80: 1, 9: 2}
    assert dict(rows(encode.encode_ids(df, "s", "x"), "s", "x")) == {"B": 0, "b": 1, "mm": 2}


def test_splits(spark):
    df = spark.createDataFrame([(u, 7 * m % 31, 100 * m) for u in (4, 5, 6) for m in range(30)] + [(9, 1, 1)], "user_id int, item_id int, t int")
    parts = split.per_user_split(df, ["t", "item_id"])
    got = {(r.user_id, r.split): r["count"] for r in parts.groupBy("user_id", "split").count().collect()}
    assert {k: n for k, n in got.items() if k[0] != 9} == {(u, s): n for u in (4, 5, 6) for s, n in (("train", 24), ("validation", 3), ("test", 3))}
    late = parts.where("user_id = 4").groupBy("split").agg(F.min("t").alias("a"), F.max("t").alias("z")).collect()
    span = {r.split: (r.a, r.z) for r in late}
    assert span["train"][1] < span["validation"][0] and span["validation"][1] < span["test"][0]
    rng = random.Random(27)
    log = [(rng.randrange(6), rng.randrange(8), rng.randrange(6), k) for k in range(80)]
    mixed = split.explicit_boundary_split(spark.createDataFrame(log, "user_id int, item_id int, rating int, ts int"), ["ts"], 0.5, 0.25)
    seen = {r.item_id for r in mixed.where("split = 'train'").select("item_id").distinct().collect()}
    assert {r.item_id for r in mixed.where("split != 'train'").collect()} <= seen


def test_cf_estimates_and_fallback(spark):
    # Two tastes: even users like even items; user 0 has not met item 6, user 1 not item 7.
    data = [(u, i, 5 - 3 * ((u + i) % 2) - (u * i) % 2) for u in range(6) for i in range(8) if (u, i) not in {(0, 6), (1, 7), (1, 6)}]
    df = spark.createDataFrame(data, "user_id int, item_id int, rating int")
    user = neighborhood.NeighborhoodCF("user", "mean_centered", 3, 2, 0.0).fit(df)
    p = user.predict(spark.createDataFrame([(0, 6), (77, 6)], "user_id int, item_id int")).orderBy("user_id").collect()
    assert not p[0].used_fallback and p[0].rating_estimate > 3.5 and p[1].used_fallback
    item = neighborhood.NeighborhoodCF("item", "bias_aware", 3, 2, 0.0).fit(df)
    recs = item.recommend(spark.createDataFrame([(0,), (1,), (77,)], "user_id int"), 2).orderBy("user_id", "rank").collect()
    assert [r.item_id for r in recs if r.user_id == 0] == [6]
    assert [r.item_id for r in recs if r.user_id == 1] == [7, 6]
    assert [(r.used_fallback, r.evidence) for r in recs if r.user_id == 77] == [(True, 0.0)] * 2


def test_similarities_of_split_lists_and_entities(spark, monkeypatch):
    rng = np.random.default_rng(28)
    data = [(u, i, float(rng.integers(1, 6))) for u in range(25) for i in range(30) if u == 0 or rng.random() < 0.3]
    res, _ = neighborhood.residuals(spark.createDataFrame(data, "user_id int, item_id int, rating double"), "mean_centered")
    whole = sorted(rows(neighborhood.top_similar(res, "item_id", "user_id", 5, 2, 3.0), "entity", "neighbor", "similarity", "support"))
    for lists, split_rows in ((4, 10**6), (4, 3), (10**6, 3)):
        monkeypatch.setattr(neighborhood, "LIST", lists)
        monkeypatch.setattr(neighborhood, "SPLIT_ROWS", split_rows)
        cut = sorted(rows(neighborhood.top_similar(res, "item_id", "user_id", 5, 2, 3.0), "entity", "neighbor", "similarity", "support"))
        assert [(a, b, n) for a, b, _, n in cut] == [(a, b, n) for a, b, _, n in whole]
        assert np.allclose([r[2] for r in cut], [r[2] for r in whole])


def test_cf_similarity_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 6, (15, 8)).astype(float) * (rng.random((15, 8)) < 0.6)
    df = spark.createDataFrame([(u, i, float(m[u, i])) for u in range(15) for i in range(8) if m[u, i] > 0], "user_id int, item_id int, rating double")
    res, _ = neighborhood.residuals(df, "mean_centered")
    got = {(r.entity, r.neighbor): r.similarity for r in neighborhood.top_similar(res, "item_id", "user_id", 99, 2, 5.0).collect()}
    mask = m > 0
    r = np.where(mask, m - (m.sum(1) / np.maximum(mask.sum(1), 1))[:, None], 0)
    n = np.linalg.norm(r, axis=0)
    cos, sup = (r.T @ r) / np.outer(n, n), mask.T.astype(int) @ mask
    want = {(a, b): cos[a, b] * sup[a, b] / (sup[a, b] + 5) for a in range(8) for b in range(8) if a != b and cos[a, b] > 1e-12 and sup[a, b] >= 2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_top_n_order(spark):
    rng = random.Random(29)
    data = [(u, i, float(rng.randrange(2)), rng.choice([None, 0.5, 1.5]), rng.randrange(2)) for u in range(4) for i in range(12)]
    top = baselines.top_per_user(spark.createDataFrame(data, "user_id int, item_id int, score double, s double, e int"), 5, secondary=("s", "e"))
    order = lambda r: (-r[2], -(r[3] if r[3] is not None else -9), -r[4], r[1])
    want = {(u, n): r[1] for u in range(4) for n, r in enumerate(sorted((r for r in data if r[0] == u), key=order)[:5], 1)}
    assert {(u, n): i for u, n, i in rows(top, "user_id", "rank", "item_id")} == want


def test_popular_unseen_against_brute_force(spark):
    rng = random.Random(30)
    scores = {i: float(rng.randrange(6)) for i in range(40)}
    seen = [(0, i) for i in range(36)] + [(1, i) for i in range(40)] + [(u, rng.randrange(45)) for u in range(2, 9) for _ in range(8)] + [(9, None)]
    df = spark.createDataFrame(list(scores.items()), "item_id int, score double")
    got = baselines.popular_unseen(df, spark.createDataFrame(seen, "user_id int, item_id int"), 5)
    want = {}
    for u in {u for u, _ in seen}:
        own = {i for v, i in seen if v == u}
        want |= {(u, n): i for n, i in enumerate([i for i in sorted(scores, key=lambda i: (-scores[i], i)) if i not in own][:5], 1)}
    assert {(u, n): i for u, n, i in rows(got, "user_id", "rank", "item_id")} == want


def test_ties_and_list_statistics(spark):
    lists = [[2.0] * 4, [2.0, 2.0, 1.0, 1.0], [4.0, 3.0, 2.0, 1.0], [3.0, 2.0, 2.0, 2.0]]
    df = spark.createDataFrame([(u, s) for u, own in enumerate(lists) for s in own], "user_id int, s double")
    r = metrics.tie_statistics(df, "user_id", "s").first()
    assert (r.lists, r.fully_tied, r.largest) == (4, 1 / 4, 4) and abs(r.entries_tied - 11 / 16) < 1e-12
    recs = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (2, 9), (3, 8)], "user_id int, item_id int")
    counts = spark.createDataFrame([(k, 100 - 10 * k) for k in range(10)], "item_id int, n int")
    s = metrics.list_statistics(recs, counts, 10).first()
    assert (s.coverage, s.long_tail) == (0.3, 1.0) and s.novelty > 0


def test_bootstrap(spark):
    df = spark.createDataFrame([(k, -0.1) for k in range(3)], "u int, d double")
    r = metrics.bootstrap_interval(df, "u", "d", 200).first()
    assert (r.users, round(r["mean"], 9), round(r.low, 9), round(r.high, 9)) == (3, -0.1, -0.1, -0.1)
    wide = spark.createDataFrame([(k, float(k % 10)) for k in range(400)], "u int, d double")
    r = metrics.bootstrap_interval(wide, "u", "d", 500).first()
    assert r.low < 4.5 < r.high and 0.4 < r.high - r.low < 0.75


def test_als_half_step_is_the_ridge_solution(spark):
    data = [(0, 0, 5.0), (0, 1, 3.0), (1, 0, 4.0), (1, 2, 1.0), (2, 1, 2.0), (2, 2, 5.0)]
    q = np.array([[0.2, 0.8], [0.6, 0.4], [0.9, 0.1]])
    t = spark.createDataFrame(data, "user_id int, item_id int, value double")
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "idx int, f array<double>")
    got = dict(rows(factor.als_half_step(t, "user_id", "item_id", f, 2, 0.1), "idx", "f"))
    want = np.linalg.solve(q[:2].T @ q[:2] + 0.1 * np.eye(2), q[:2].T @ [5, 3])
    assert np.allclose(got[0], want) and len(got) == 3


def _ratings(spark, n=30, m=20, seed=0):
    rng = np.random.default_rng(seed)
    p, q = rng.random((n, 2)) + 0.5, rng.random((m, 2)) + 0.5
    data = [(u, i, float(np.clip(p[u] @ q[i] + 1, 1, 5)), bool(rng.random() < 0.5), False) for u in range(n) for i in range(m) if rng.random() < 0.5]
    return spark.createDataFrame(data, "user_id int, item_id int, rating double, is_read boolean, is_reviewed boolean")


def test_factor_models_learn(spark):
    df = _ratings(spark)
    t = df.select("user_id", "item_id", F.col("rating").alias("value"))
    spread = t.agg(F.stddev_pop("value")).first()[0]
    assert factor.observed_rmse(t, factor.fit_als(df, 3, 0.05, 4)) < 0.3 * spread
    assert factor.observed_rmse(t, factor.fit_als(df, 2, 1.0, 3, biased=True)) < 0.8 * spread
    nmf = factor.fit_nmf(df, 3, 0.0, 21, tol=0.0)
    assert nmf.history == sorted(nmf.history, reverse=True) and nmf.history[-1] < spread
    assert min(min(r.f) for r in nmf.items.collect()) >= 0
    model, _ = factor.fit_svdpp(df, 2, 0.05, 0.01, 3, blocks=2)
    assert factor.observed_rmse(t, model) < spread


def test_busy_rows_of_als_are_summed_in_several_tasks(spark, monkeypatch):
    df = _ratings(spark)
    whole = dict(rows(factor.fit_als(df, 3, 0.05, 2).users, "idx", "f"))
    monkeypatch.setattr(factor, "SPLIT_RATINGS", 4)
    cut = dict(rows(factor.fit_als(df, 3, 0.05, 2).users, "idx", "f"))
    assert cut.keys() == whole.keys() and all(np.allclose(cut[u], whole[u]) for u in whole)


def test_svdpp_stops_early_and_returns_the_best_epoch(spark):
    df = _ratings(spark, seed=4)
    model, y = factor.fit_svdpp(df, 2, 0.3, 0.0, 8, blocks=1, validation=df.where("user_id % 5 = 0").withColumn("rating", 6 - F.col("rating")), patience=2)
    assert len(model.history) == model.history.index(min(model.history)) + 3 < 8 or len(model.history) == 8
    again, _ = factor.fit_svdpp(df, 2, 0.3, 0.0, model.history.index(min(model.history)) + 1, blocks=1)
    a, b = (dict(rows(m.users, "idx", "f")) for m in (model, again))
    assert all(np.allclose(a[u], b[u]) for u in a)


@pytest.mark.parametrize("biased", [False, True])
def test_block_sgd_equals_one_sequential_pass(spark, biased):
    df = _ratings(spark, 12, 9, 3)
    k, blocks, seed, epochs, rate, reg = 2, 3, 42, 2, 0.05, 0.02
    model = factor.fit_sgd(df, None, k, rate, reg, epochs, blocks=blocks, biased=biased, seed=seed)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    start = {}
    for n, c in enumerate(("user_id", "item_id")):
        start[c] = dict(rows(factor.initial_factors(df.select(F.col(c).alias("idx")).distinct(), k, seed + n), "idx", "f"))
    p, q = (np.array([start[c][x] for x in sorted(start[c])]) for c in ("user_id", "item_id"))
    bu, bi = (np.zeros(len(x)) for x in (p, q))
    pu, pi = ({x: n for n, x in enumerate(sorted(start[c]))} for c in ("user_id", "item_id"))
    mu = df.agg(F.avg("rating")).first()[0] if biased else 0.0
    for e in range(epochs):
        order = df.select("user_id", "item_id", "rating", block(F.col("user_id")).alias("ub"), block(F.col("item_id")).alias("ib"), F.xxhash64("user_id", "item_id", F.lit(e), F.lit(seed)).alias("h")).collect()
        order.sort(key=lambda r: ((r.ub - r.ib) % blocks, r.ub, r.h))
        factor.sgd_pass([pu[r.user_id] for r in order], [pi[r.item_id] for r in order], [r.rating for r in order], p, q, bu if biased else None, bi if biased else None, mu, rate, reg)
    got = dict(rows(model.users, "idx", "f"))
    assert np.allclose([got[x] for x in sorted(got)], p)
    if biased:
        got = dict(rows(model.biases[2], "item_id", "bi"))
        assert np.allclose([got[x] for x in sorted(got)], bi)


def test_svdpp_estimate_formula():
    p, q, y = np.array([0.5, 1]), np.array([2.0, -1]), np.array([[1.0, 0], [0, 2]])
    assert abs(factor.svdpp_estimate(3, 0.2, -0.1, p, q, y) - (3 + 0.2 - 0.1 + q @ (p + np.array([1, 2]) / math.sqrt(2)))) < 1e-12


def test_in_batch_loss_masks_duplicates(spark):
    v = np.array([[1.0, 0], [1, 0], [0, 1]])
    want = (2 * math.log(1 + math.exp(-1)) + math.log(1 + 2 * math.exp(-1))) / 3
    assert abs(towers.batch_loss(v, v, np.array([5, 5, 6])) - want) < 1e-12
    assert towers.batch_loss(v, v, np.array([5, 5, 5])) == 0
    df = spark.createDataFrame([(1, a.tolist(), a.tolist(), i) for a, i in zip(v, (5, 5, 6), strict=True)], "b int, user_v array<double>, item_v array<double>, item_id int")
    assert abs(towers.in_batch_losses(df, "b").first().loss - want) < 1e-12


def test_pooling():
    h, mask = np.ones((2, 3, 4)), np.array([[False, True, True], [False, False, False]])
    assert np.allclose(towers.attention_pool(np.ones((2, 4)), h, mask), [[1] * 4, [0] * 4])
    w, u, b = np.ones((4, 8)), np.ones((2, 8)), np.zeros(8)
    out = towers.lstm_pool(h, mask, w, u, b)
    assert (out[0] > 0).all() and (out[1] == 0).all()
    assert np.allclose(np.linalg.norm(towers.forward(np.ones((3, 4)), [(np.ones((4, 2)), np.zeros(2))]), axis=1), 1)


def test_encoding_is_fit_on_its_rows_only(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, None, None), (2, "new", 1e12)], "item_id int, kind string, x double")
    fit = df.where("item_id < 2")
    coded = encode.apply_vocabulary(df, "kind", encode.fit_vocabulary(fit, "kind"), "code")
    assert dict(rows(coded, "item_id", "code")) == {0: 2, 1: 1, 2: 0}
    scaled = dict(rows(encode.standardize(df, ["x"], fit), "item_id", "x"))
    assert scaled[0] == 0 and scaled[1] == 0 and scaled[2] == 1e12 - 1
    assert [x for (x,) in rows(encode.min_max(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"]), "x")] == [0.0, 0.0]


def test_scalars(spark):
    df = spark.createDataFrame([("['A b', 'C']",), ('["It\'s", \'x\']',), ("[bare]",), ("",)], "s string")
    assert [x for (x,) in rows(df, S.first_of_list_text(F.col("s")))] == ["A b", "It's", "bare", ""]
    one = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "h array<bigint>")
    assert rows(one, S.right_aligned(F.col("h"), 2), S.pad_mask(F.col("h"), 2)) == [([2, 3], [True, True]), ([-1, -1], [False, False]), ([-1, -1], [False, False])]
    v = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    c = lambda w: S.weighted_cosine(F.col("a"), F.col("b"), F.array(*map(F.lit, w)))
    high, low, none = v.select(c([2.0, 1.0]), c([1.0, 2.0]), c([0.0, 0.0])).first()
    assert high > low and none == 0
    week = spark.createDataFrame([(4 * 86_400_000,)], "t long").select(*S.cyclic(F.col("t")).values()).first()
    assert np.allclose(week, [0, 1, 0, 1])  # Monday, midnight


def test_selection(spark):
    df = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "run string, epoch int, s double")
    got = {r.epoch: (r.best_epoch, r.waited, r.stopped) for r in select.early_stopping(df, "run", "epoch", ["s"], 2).collect()}
    assert got == {0: (0, 0, False), 1: (1, 0, False), 2: (1, 1, False), 3: (1, 2, True), 4: (4, 0, True)}
    assert select.best_with_ties(df, ["run"], "s").count() == 1
    q = select.nearest_to_quantiles(spark.createDataFrame([(k, k * 10) for k in range(5)], "u int, n int"), "u", "n", [0.5, 0.5])
    assert [r.u for r in q.collect()] == [2, 1]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert rows(checks.duplicate_keys(df, ["k"]), "k", "n") == [(1, 2)]
    bad = checks.violations(df, {"no_v": F.col("v").isNull()})
    with pytest.raises(ValueError):
        checks.require(bad, "table")
    checks.require(bad.where("n > 9"), "table")
    assert checks.missing_columns(df, ["k", "z"]) == ["z"]
    nested = spark.createDataFrame([], "a struct<user_id: int, x: array<struct<email: string>>>").schema
    assert checks.private_fields(nested, ["user_id", "email"]) == ["a.user_id", "a.x.email"]
    assert checks.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'


def test_profiles(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None), (None, [3])], "n int, h array<bigint>")
    got = dict(rows(profile.length_histogram(df, "h", 3), "length", "n"))
    assert got == {0: 2, 1: 1, 2: 1, 3: 0}
    p = profile.column_profile(df, ["n"]).first()
    assert (p.rows, p.missing, p.cardinality, p.quantiles[2]) == (4, 1, 3, 2.0)
    pct = dict(rows(profile.popularity_percentiles(spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "i int, n int"), "i", "n"), "i", "percentile"))
    assert np.allclose([pct[1], pct[2], pct[3]], [0.5, 0.5, 1.0])


def test_stratified_sample(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(30)], "id int, s int")
    got = encode.stratified_sample(df, 12, ["s"], "id", [F.asc("id")])
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {0: 4, 1: 4, 2: 4}
    assert got.collect() == encode.stratified_sample(df.repartition(5), 12, ["s"], "id", [F.asc("id")]).collect()


@pytest.mark.parametrize("biased", [False, True])
def test_catalog_lists_against_brute_force(spark, monkeypatch, biased):
    monkeypatch.setattr(factor, "_ITEM_BLOCK", 7)
    rng = np.random.default_rng(8)
    train = spark.createDataFrame([(u, i, int(rng.integers(1, 6))) for u in range(40) for i in range(60) if rng.random() < (0.95 if u == 0 else 0.1)], "user_id long, item_id long, rating int")
    model = factor.fit_als(train, k=3, iterations=2, biased=biased)
    pairs = train.select("user_id").distinct().crossJoin(train.select("item_id").distinct())
    expected = set(rows(model.recommend(pairs, train, 5), "user_id", "item_id", "rank"))
    assert set(rows(model.recommend_catalog(train, 5), "user_id", "item_id", "rank")) == expected


def test_factor_lists_reach_every_user(spark, tmp_path):
    import datetime

    from kelpwright.plans.models import registry

    # Users that share no item: none has a similar user.
    orders = [(10 * u + k, u, datetime.date(2020, 1, 1 + k)) for u in range(6) for k in range(10)]
    lines = [(o, 100 * u + o % 10, float(1 + 5 * (o % 10)), "N", "F") for o, u, _ in orders]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(registry.queries["k08_factor_recommend"](spark, str(tmp_path)), "user_id", "item_id", "rank")
    assert {(u, r) for u, _, r in got} == {(u, r) for u in range(6) for r in range(1, 11)}


def test_rolling_history_counts_more_than_a_million(spark, tmp_path):
    from kelpwright.plans.protocol import registry

    n = 1_000_050
    late = F.col("id") == n
    e = spark.range(n + 1).select(F.col("id").cast("string").alias("request_id"), F.lit(1).cast("long").alias("user_id"), F.col("id").alias("item_id"), F.when(late, 1721000000000).otherwise(5).cast("long").alias("request_time_ms"), F.lit(True).alias("long_view"), F.lit(False).alias("is_random"))
    e.write.parquet(f"{tmp_path}/impressions.parquet")
    assert rows(registry.queries["h06_rolling_history"](spark, str(tmp_path)), "request_id", "n_prior", "latest_ms") == [(str(n), n, 5)]

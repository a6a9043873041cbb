import numpy as np

from kelpwright.operators import blocks, factor
from kelpwright.storage import Workspace


def test_half_steps_look_factors_up_instead_of_joining_them(spark, monkeypatch):
    rng = np.random.default_rng(61)
    data = [(u, i, float(rng.integers(1, 6))) for u in range(30) for i in range(12) if u == 0 or rng.random() < 0.4] + [(31, None, 3.0)]
    df = spark.createDataFrame(data, "user_id int, item_id long, rating double")
    monkeypatch.setattr(blocks, "BLOCK_RATINGS", 20)
    monkeypatch.setattr(blocks, "HELD_RATINGS", 15)
    monkeypatch.setattr(factor, "als_half_step", None)  # not called
    model = factor.fit_als(df, k=4, reg=0.3, iterations=2)
    data = [r for r in data if r[1] is not None]
    start = factor.initial_factors(spark.createDataFrame([(i,) for i in range(12)], "idx long"), 4, 42)
    sides = {1: {r.idx: np.array(r.f) for r in start.collect()}, 0: {}}
    for _ in range(2):
        for own, other in ((0, 1), (1, 0)):
            new = {}
            for x in {r[own] for r in data}:
                q, v = (np.array(c) for c in zip(*((sides[other][r[other]], r[2]) for r in data if r[own] == x), strict=True))
                new[x] = np.linalg.solve(q.T @ q + 0.3 * np.eye(4), q.T @ v)
            sides[own] = new
    for df, want in ((model.users, sides[0]), (model.items, sides[1])):
        got = {r.idx: r.f for r in df.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x]) for x in want)


def test_factors_reach_the_model_without_a_join_or_a_broadcast(spark, monkeypatch):
    plans, write = {}, Workspace.write

    def kept(space, df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(space, df, name, **options)

    monkeypatch.setattr(Workspace, "write", kept)
    df = spark.range(20_000).selectExpr("id % 4000 AS user_id", "concat('i', id * 7 % 3000) AS item_id", "1D + id % 5 AS rating")
    model = factor.fit_als(df, k=50, iterations=1)
    assert not any("Join" in plans[name] or "Broadcast" in plans[name] for name in ("users", "items"))
    plans["predicted"] = model.predict(df)._jdf.queryExecution().executedPlan().toString()
    assert not any("Broadcast" in plans[name] for name in ("placed", "predicted"))
    assert model.users.count() == 4000 and {r.idx for r in model.items.select("idx").collect()} == {f"i{n}" for n in range(3000)}


def test_a_row_whose_ratings_all_lack_the_other_side_has_no_factors(spark):
    df = spark.createDataFrame([(0, None, 3.0), (1, 5, 4.0), (1, 6, 2.0), (2, 6, 5.0), (None, 4, 1.0)], "user_id int, item_id long, rating double").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # one block, so that these rows come first in theirs
    try:
        model = factor.fit_als(df, k=3, iterations=2)
        assert ({r.idx for r in model.users.collect()}, {r.idx for r in model.items.collect()}) == ({1, 2}, {5, 6})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_predictions_look_factors_up_as_the_joined_ones_do(spark):
    df = spark.range(3000).selectExpr("id % 90 AS user_id", "concat('i', id * 7 % 80) AS item_id", "1D + id % 5 AS rating")
    model = factor.fit_als(df, k=4, iterations=2, biased=True)
    pairs = spark.createDataFrame([(n, u, i) for n, (u, i) in enumerate([(u, f"i{i}") for u in (0, 5, 95) for i in (3, 79, 80)] + [(None, "i3"), (5, None), (None, None)])], "n int, user_id long, item_id string")
    got = model.predict(pairs.repartition(2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and " f#" not in plan  # no factor is joined
    model.placed = None
    joined = model.predict(pairs)
    assert got.dtypes == joined.dtypes
    want = {r.n: r.prediction for r in joined.collect()}
    assert len(want) == 12 and {r.n: round(r.prediction, 9) for r in got.collect()} == {n: round(x, 9) for n, x in want.items()}

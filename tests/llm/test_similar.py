import math

import numpy as np

from kelpwright.llm.similar import Setting, most_similar

SCHEMA = "id int, v array<float>, cosine double"


def brute(vectors, k, least):
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = m @ m.T
    np.fill_diagonal(cos, -9)
    order = np.lexsort((np.broadcast_to(ids, cos.shape), -np.round(cos, 6)), axis=1)[:, :k]
    return {(int(ids[a]), int(ids[b])) for a, near in enumerate(order) for b in near if cos[a, b] >= max(least, -2)}


def run(spark, rows, **kw):
    got = most_similar(spark.createDataFrame(rows, SCHEMA), "id", "v", **kw)
    assert got.columns == ["idx", "neighbor_idx", "cosine"]
    return got.collect()


def clustered(seed, clusters, each, spread):
    rng = np.random.default_rng(seed)
    out = {}
    for c in range(clusters):
        centre = rng.normal(size=50)
        for _ in range(each):
            out[len(out) * 3 + c % 2] = (centre + spread * rng.normal(size=50)).astype(np.float32).tolist()
    return out


def test_recall_and_no_false_pairs(spark):
    vectors = clustered(1, 300, 6, 0.25)
    rows = [(i, v, 0.0) for i, v in vectors.items()]
    truth = brute(vectors, 10, 0.9)
    got = {(r.idx, r.neighbor_idx) for r in run(spark, rows + rows[:50], min_cosine=0.9)}
    assert len(truth & got) >= 0.9 * len(truth)
    assert len(got - truth) <= 0.02 * len(truth)  # in the place of a missed one


def test_whole_top_k_without_a_floor_has_no_wrong_order(spark):
    vectors = clustered(2, 40, 12, 0.3)
    got = run(spark, [(i, v, None) for i, v in vectors.items()], k=5)
    truth = brute(vectors, 5, -1)
    assert len(truth & {(r.idx, r.neighbor_idx) for r in got}) >= 0.9 * len(truth)
    assert max(np.bincount([r.idx for r in got])) <= 5


def isotropic(seed, n, dim=50):
    return dict(enumerate(np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).tolist()))


def test_recall_at_the_defaults_on_vectors_without_clusters(spark):
    vectors = isotropic(7, 3000)
    truth = brute(vectors, 10, -1)
    got = {(r.idx, r.neighbor_idx) for r in run(spark, [(i, v, None) for i, v in vectors.items()])}
    assert len(got) == 10 * len(vectors)
    assert len(truth & got) >= 0.9 * len(truth)


def test_queries_limit_who_asks_and_not_who_is_found(spark):
    vectors = isotropic(8, 1500)
    vectors[1500] = vectors[100]  # an asked one that stands for none, and one that is not asked
    rows = [(i, v, None) for i, v in vectors.items()]
    asked = spark.createDataFrame([(i, "x") for i in range(0, 1600, 100)] + [(None, "y"), (100, "z")], "id int, cosine string")
    got = run(spark, rows, queries=asked)
    assert {r.idx for r in got} == set(range(0, 1501, 100))
    truth = {p for p in brute(vectors, 10, -1) if p[0] % 100 == 0}
    assert len(truth & {(r.idx, r.neighbor_idx) for r in got}) >= 0.9 * len(truth)


def test_every_bucket_visited_is_exact(spark):
    vectors = isotropic(9, 700, 12) | {k + 700: v for k, v in clustered(3, 4, 50, 0.02).items() if len(v) == 12}
    got = {(r.idx, r.neighbor_idx) for r in run(spark, [(i, v, None) for i, v in vectors.items()], setting=Setting(4, 2.5, 1, 256, 0.5))}
    assert got == brute(vectors, 10, -1)


def test_tasks_and_blocks_change_nothing(spark):
    vectors = clustered(3, 4, 150, 0.02) | {k + 10_000: v for k, v in isotropic(4, 600).items()}
    rows, setting, got = [(i, v, None) for i, v in vectors.items()], Setting(6, 2.5, 2, 8, 0.6), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(sorted((r.idx, r.neighbor_idx) for r in run(spark, rows, setting=setting)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_a_cluster_well_above_the_cap(spark):
    vectors = clustered(5, 1, 14_000, 0.02)
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    asked = np.arange(0, len(ids), 50)
    cos = np.round(m[asked] @ m.T, 6)
    cos[np.arange(len(asked)), asked] = -2
    order = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :10]
    truth = {(int(ids[a]), int(ids[b])) for a, near in zip(asked, order, strict=True) for b in near}
    got = {(r.idx, r.neighbor_idx) for r in run(spark, [(i, v, None) for i, v in vectors.items()], min_cosine=0.9)}
    assert len(truth & got) >= 0.9 * len(truth)


def test_dimensions_below_the_functions(spark):
    vectors = isotropic(6, 400, 3)
    got = {(r.idx, r.neighbor_idx) for r in run(spark, [(i, v, None) for i, v in vectors.items()], k=3)}
    truth = brute(vectors, 3, -1)
    assert len(truth & got) >= 0.9 * len(truth)


def test_equal_vectors_nulls_and_zeros(spark):
    one = [1.0] + [0.0] * 49
    near = [1.0, 0.1] + [0.0] * 48
    rows = [(i, one, None) for i in range(15)] + [(20, near, None), (20, near, None), (21, [2 * x for x in one], None)]
    rows += [(30, None, None), (31, [0.0] * 50, None), (32, [math.nan] * 50, None), (None, one, None), (33, [], None), (34, [1.0, None], None), (35, [math.inf] * 50, None)]
    got = {}
    for r in sorted(run(spark, rows, min_cosine=0.9), key=lambda r: (-round(r.cosine, 6), r.neighbor_idx)):
        got.setdefault(r.idx, []).append(r.neighbor_idx)
    assert set(got) == {*range(15), 20, 21}
    assert got[0] == list(range(1, 11))
    assert got[14] == list(range(10))
    assert got[21] == list(range(10)) and got[20] == list(range(10))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []

import random

import pytest
from pyspark.sql import functions as F

from kelpwright.operators.asof import UNKNOWN_MS, attributes_as_known, request_items
from kelpwright.operators.sessions import sessionize
from kelpwright.operators.skew import counts_per_key, heavy_keys

DAY = 86_400_000


def brute_sessions(rows, gap):
    first = {}
    for e, u, t, tab in rows:
        if u is not None and t is not None:
            key = (t, u, tab is None, tab if tab is not None else 0)
            if e is None:
                first[(None, u, t, tab)] = key
            elif e not in first or key < first[e]:
                first[e] = key
    users = {}
    for t, u, no_tab, tab in first.values():
        users.setdefault(u, []).append((t, None if no_tab else tab))
    out = []
    for u, own in users.items():
        own.sort(key=lambda x: x[0])
        cur = []
        for t, tab in own:
            if cur and t - cur[-1][0] > gap:
                out.append((u, cur))
                cur = []
            cur.append((t, tab))
        out.append((u, cur))
    return sorted((u, c[0][0], c[-1][0], len(c), len({x for _, x in c if x is not None})) for u, c in out)


EVENTS = "request_id string, user_id long, request_time_ms long, tab long, start_ms string"


def test_sessions_against_brute_force(spark):
    rng = random.Random(2)
    gap = 1_800_000
    rows = []
    for k in range(4000):
        t = rng.choice([None, rng.randrange(-3 * DAY, 3 * DAY), rng.randrange(0, 40) * gap, DAY - 1, DAY, DAY + gap, DAY + gap + 1])
        rows.append((rng.choice([None, *(f"r{rng.randrange(3000)}" for _ in range(20))]), rng.choice([None, 1, 1, 1, 1, 2, 3, rng.randrange(50)]), t, rng.choice([None, 0, 1, 2])))
    rows += rows[:500]
    df = spark.createDataFrame([(*r, "x") for r in rows], EVENTS)
    got = sessionize(df)
    assert got.columns == ["user_id", "start_ms", "end_ms", "n_events", "n_tabs"]
    assert sorted(map(tuple, got.collect())) == brute_sessions(rows, gap)
    assert sorted(map(tuple, sessionize(df, block_ms=7).collect())) == brute_sessions(rows, gap)


def test_sessions_of_one_hot_user_and_empty(spark):
    df = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit(1).alias("user_id"), (F.col("id") * 1000).alias("request_time_ms"), F.lit(None).cast("long").alias("tab"))
    assert list(map(tuple, sessionize(df).collect())) == [(1, 0, 19_999_000, 20_000, 0)]
    assert sessionize(df.limit(0)).collect() == []


REQ = "request_id string, item_id long, time_ms long, history_item_ids array<long>, version_no string"
VERSIONS = "item_id long, version_no int, eligible_after_ms long, first_observed_ms long, time_ms int"


@pytest.mark.parametrize("log_entries", [256, 1])
def test_as_known_against_brute_force(spark, log_entries):
    rng = random.Random(6)
    when = lambda: rng.choice([None, UNKNOWN_MS, rng.randrange(0, 50), rng.randrange(0, 50), rng.randrange(0, 50)])
    versions = [(rng.choice([None, *range(8)]), rng.randrange(1, 5), when(), when(), 0) for _ in range(150)]
    versions += versions[:40]
    requests = [(f"q{k}", rng.choice([None, *range(10)]), rng.choice([None, *range(60)]), rng.choice([None, [], [rng.choice([None, *range(10)]) for _ in range(5)]]), "z") for k in range(120)]
    requests += requests[:30]
    events = request_items(spark.createDataFrame(requests, REQ))
    got = attributes_as_known(events, spark.createDataFrame(versions, VERSIONS), period_ms=7, log_entries=log_entries)
    want = set()
    for q, item, t, history, _ in requests:
        for i in {item, *(history or [])} - {None} if t is not None else ():
            ok = [(v[2], v[1]) for v in versions if v[0] == i and v[2] is not None and v[3] is not None and v[2] <= t and v[3] <= t]
            if ok:
                want.add((q, i, max(ok)[1]))
    rows = [(r.request_id, r.item_id, r.version_no) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_request_logged_with_different_lists_has_all_items(spark):
    rows = [("a", 1, 5, [2], ""), ("a", 1, 9, [3, None], ""), ("a", 4, None, [5], "")]
    got = request_items(spark.createDataFrame(rows, REQ)).select("request_id", "item_id", "time_ms").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 9), ("a", 2, 5), ("a", 3, 9)]


def test_as_known_with_odd_clocks(spark):
    times = [9_000_000_000_000_000_000, -(2**62), -1, 0, 5, 4_100_000_000_000_000, 2**63 - 1]
    events = spark.createDataFrame([(f"q{k}", 1, t) for k, t in enumerate(times)], "request_id string, item_id long, time_ms long")
    versions = spark.createDataFrame([(1, 1, -(2**61), -5, 0), (1, 2, 3, 3, 0), (1, 3, 4_000_000_000_000_000, 0, 0), (1, 4, 8_999_999_999_999_999_999, 1, 0)], VERSIONS)
    for log_entries in (256, 0):
        got = {r.request_id: r.version_no for r in attributes_as_known(events, versions, log_entries=log_entries).collect()}
        assert got == {"q0": 4, "q2": 1, "q3": 1, "q4": 2, "q5": 3, "q6": 4}


def test_as_known_empty(spark):
    events = request_items(spark.createDataFrame([], REQ))
    versions = spark.createDataFrame([], VERSIONS)
    assert attributes_as_known(events, versions).collect() == []
    one = request_items(spark.createDataFrame([("a", 1, 5, None, "")], REQ))
    assert attributes_as_known(one, versions).collect() == []


def test_counts_with_heavy_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", f"k{rng.randrange(500)}"]), rng.choice([None, f"r{rng.randrange(2000)}"]), rng.choice([None, rng.randrange(300)]), 1) for _ in range(6000)]
    df = spark.createDataFrame(rows, "k string, r string, u long, n_users int")
    for record in ("r", None):
        want = {}
        for k, r, u, _ in rows:
            if k is not None:
                own = want.setdefault(k, [set(), set(), 0])
                own[0] |= {r} - {None}
                own[1] |= {u} - {None}
                own[2] += 1
        for sample in (10**6, 300):
            got = counts_per_key(df, "k", record, "u", share=0.05, sample_rows=sample)
            assert {r.k: (r.n_records, r.n_users) for r in got.collect()} == {k: (len(v[0]) if record else v[2], len(v[1])) for k, v in want.items()}
    assert [r.k for r in heavy_keys(df, "k", 0.05).collect()] == ["hot"]
    assert counts_per_key(df.limit(0), "k", "r", "u").collect() == []

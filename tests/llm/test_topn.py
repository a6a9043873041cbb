import math
import random

from kelpwright.llm.topn import top_n_per_group

SCHEMA = "user_id int, movie_id int, score double, second double, weight double, pos string"


def brute(rows, n):
    last = lambda v: (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)
    out, seen, count = [], set(), {}
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and math.isfinite(r[2])]
    for r in sorted(good, key=lambda r: (r[0], -r[2], tuple(-x for x in last(r[3])), tuple(-x for x in last(r[4])), r[1])):
        if (r[0], r[1]) in seen or count.get(r[0], 0) == n:
            continue
        seen.add((r[0], r[1]))
        count[r[0]] = count.get(r[0], 0) + 1
        out.append((r[0], count[r[0]], r[1]))
    return sorted(out)


def run(spark, rows, n=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = top_n_per_group(df, "user_id", "score", "movie_id", ("second", "weight"), n=n, **kw)
    assert got.columns == ["user_id", "pos", "movie_id"]
    return sorted(tuple(r) for r in got.collect())


def test_random_lists_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for _ in range(3000):
        user = pick(None, 1, 1, 1, 1, 1, 1, *range(2, 40))
        score = pick(None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5, 2.5, rng.random())
        rows.append((user, pick(None, *range(300)), score, pick(None, math.nan, 1.0, 2.0), pick(None, 0.5, 0.5, math.inf), "x"))
    rows += rows[:500]
    assert run(spark, rows, row_group_rows=64) == brute(rows, 3)
    assert run(spark, rows, n=1) == brute(rows, 1)


def test_row_groups_of_a_large_group_are_skipped(spark):
    rows = [(7, i, float(i), None, None, None) for i in range(5000)]
    assert run(spark, rows, row_group_rows=100) == [(7, 1, 4999), (7, 2, 4998), (7, 3, 4997)]


def test_one_item_repeated_does_not_fill_the_list(spark):
    rows = [(1, 5, 9.0, None, None, None)] * 400 + [(1, 6, 1.0, None, None, None), (1, 7, 1.0, None, None, None)]
    assert run(spark, rows, row_group_rows=50) == [(1, 1, 5), (1, 2, 6), (1, 3, 7)]


def test_empty_and_nothing_usable(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, 1.0, None, None, ""), (1, 1, None, None, None, "")]) == []


def test_string_groups_and_items(spark):
    df = spark.createDataFrame([("b", "y", 1.0), ("b", "x", 1.0), ("a", "z", 2.0), ("", "q", 0.0)], "g string, i string, s double")
    assert sorted(map(tuple, top_n_per_group(df, "g", "s", "i", n=1).collect())) == [("", 1, "q"), ("a", 1, "z"), ("b", 1, "x")]


def test_skipped_row_groups_are_never_read(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from kelpwright.llm import topn

    schema = pa.schema([("g", pa.int32()), ("item", pa.int32()), ("score", pa.float64())])
    paths = []
    for f in range(4):
        rows = pa.table({"g": [7] * 1000, "item": range(f * 1000, f * 1000 + 1000), "score": [float(5000 - f * 1000 - k) for k in range(1000)]}, schema)
        paths.append(f"file://{tmp_path}/{f}.parquet")
        pq.write_table(rows, tmp_path / f"{f}.parquet", row_group_size=50)
    listing = pa.Table.from_batches(topn._describe([pa.record_batch({"path": paths[::-1]})]))
    assert listing.num_rows == 80
    opened, read = [], []

    class Counting:
        def __init__(self, path):
            opened.append(path)
            self.file = real(path)

        def read_row_group(self, k, **kw):
            read.append(k)
            return self.file.read_row_group(k, **kw)

    real = topn._open
    monkeypatch.setattr(topn, "_open", Counting)
    best = topn._reader(10, [("score", "descending"), ("item", "ascending")], schema)(listing)
    assert sorted(best["item"].to_pylist()) == list(range(10))
    assert opened == [paths[0]] and len(read) == 1

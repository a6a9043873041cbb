import numpy as np

from kelpwright.llm.mixing import mix_sources, rake, reached_shares

DOCS = "doc_id long, source string, lang string, topic int, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(k, "big", "en" if k % 3 else "de", k % 5, 50 + k % 100) for k in range(4000)]
    rows += [(10_000 + k, "small", "en", k % 5, 80) for k in range(200)]
    rows += [(20_000 + k, "other", None, None, 30) for k in range(300)]
    rows += [(30_000, None, "en", 1, 10), (30_001, "unlisted", "en", 1, 10), (30_002, "big", "en", 1, 0), (None, "big", "en", 1, 10)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_meet_targets_and_caps_hold(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 4), ("other", 0.1, 2), ("absent", 0.2, 9)], TARGETS)
    mix = mix_sources(corpus(spark), targets)
    shares = {r.source: r for r in reached_shares(mix, targets).collect()}
    total = sum(r.tokens for r in shares.values())
    for name, share in (("big", 0.5), ("small", 0.4), ("other", 0.1)):
        assert abs(shares[name].tokens - share * total) < 400
        assert shares[name].most_copies <= shares[name].max_repeats
    assert shares["absent"].tokens == 0
    ids = [r.doc_id for r in mix.collect()]
    assert len(ids) == len(set(ids)) and not {30_000, 30_001, 30_002, None} & set(ids)


def test_same_mix_each_time_and_given_total(spark):
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 1)], TARGETS)
    a, b = (sorted(map(tuple, mix_sources(corpus(spark), targets, total_tokens=30_000).select("doc_id", "copies").collect())) for _ in range(2))
    assert a == b
    got = {r.source: r.tokens for r in reached_shares(mix_sources(corpus(spark), targets, total_tokens=30_000), targets).collect()}
    assert abs(got["big"] - 18_000) < 200 and abs(got["small"] - 12_000) < 200


def test_a_marginal_is_raked(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    mix = mix_sources(corpus(spark), targets, total_tokens=60_000, margins={"lang": {"en": 0.5, "de": 0.5}})
    tokens = {r["lang"]: r["t"] for r in mix.selectExpr("lang", "n_tokens * copies AS x").groupBy("lang").sum("x").withColumnRenamed("sum(x)", "t").collect()}
    assert abs(tokens["de"] / (tokens["en"] + tokens["de"]) - 0.5) < 0.05


def test_rake_respects_caps():
    tokens, source = np.array([100.0, 300, 50, 50]), np.array([0, 0, 1, 1])
    of = np.array([0, 1, 0, 1])
    w = rake(tokens, source, np.array([1.0, 3]), np.array([200.0, 200]), [(of, np.array([0.5, 0.5]))])
    assert (w <= np.array([1, 1, 3, 3]) + 1e-9).all()
    assert np.allclose(np.bincount(source, w * tokens), [200, 200])


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mix_sources(corpus(spark).limit(0), targets).collect() == []
    assert mix_sources(corpus(spark), targets.limit(0)).collect() == []
    assert mix_sources(corpus(spark), spark.createDataFrame([(None, 0.5, 1), ("big", None, None)], TARGETS)).collect() == []


def test_clashing_names_and_repeats(spark):
    rows = [(k % 50, "big", "en", 1, 10, k, 0.5, "x") for k in range(100)]
    sized = spark.createDataFrame(rows, DOCS + ", copies int, part double, sure string")
    mix = mix_sources(sized, spark.createDataFrame([("big", 1.0, 2)], TARGETS))
    assert mix.columns == ["doc_id", "source", "lang", "topic", "n_tokens", "part", "sure", "copies"]
    assert mix.count() == 100 and {r.copies for r in mix.collect()} == {2}

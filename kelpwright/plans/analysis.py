"""Queries of profiles, baselines, metrics, selection and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpwright.operators import baselines, checks, history, metrics, profile, select, split
from kelpwright.operators.ranking import equal_count_bucket, global_index
from kelpwright.plans.registry import Registry, table
from kelpwright.plans.views import ACTS, EVENTS, RATINGS, acts, events, ratings, with_
from kelpwright.storage import Workspace

registry = Registry()
query = registry.query

_T01 = """num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS cnt FROM ratings),
    cut AS (SELECT *, least(greatest(floor(cnt * CAST(0.8 AS DOUBLE)), 1), cnt - 2) AS a FROM num WHERE cnt >= 3),
    t01 AS (SELECT *, CASE WHEN k < a THEN 'train' WHEN k < least(greatest(floor(cnt * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))), a + 1), cnt - 1) THEN 'validation' ELSE 'test' END AS split FROM cut),
    train AS (SELECT * FROM t01 WHERE split = 'train'), test AS (SELECT * FROM t01 WHERE split = 'test')"""
_BAYES = "bayes AS (SELECT item_id, count(*) AS n, round((sum(rating) + 25 * (SELECT avg(rating) FROM train)) / (count(*) + 25), 9) AS score FROM train GROUP BY item_id)"
_LISTS = """top AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS place FROM bayes QUALIFY place <= 10 + (SELECT max(c) FROM (SELECT count(*) AS c FROM train GROUP BY user_id))),
    recs AS (SELECT u.user_id, t.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY place) AS rank FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN top t
      WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = u.user_id AND s.item_id = t.item_id) QUALIFY rank <= 10)"""
_TRUTH = "truth AS (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4 AND item_id IN (SELECT item_id FROM train))"
_PER_USER = """per_user AS (SELECT t.user_id, CAST(coalesce(h, 0) > 0 AS DOUBLE) AS hit, coalesce(h, 0) / 10.0::DOUBLE AS precision, coalesce(h, 0) / CAST(n AS DOUBLE) AS recall,
      coalesce(g, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg
      FROM (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id) t LEFT JOIN (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1)) AS g FROM recs JOIN truth USING (user_id, item_id) GROUP BY user_id) USING (user_id))"""
_PIPE = (RATINGS, _T01, _BAYES, _LISTS, _TRUTH, _PER_USER)


def _parts(spark, d):
    """Train and test rows; written once, as every query reads them several times."""
    parts = Workspace(spark, "parts").write(split.per_user_split(ratings(spark, d), ["ts", "item_id"]), "parts")
    return parts.where("split = 'train'"), parts.where("split = 'test'")


def _bayes(train):
    return baselines.bayesian_popularity(train).withColumn("score", F.round("score", 9))


def _pipeline(spark, d):
    train, test = _parts(spark, d)
    recs = baselines.popular_unseen(_bayes(train), train, 10)
    truth = test.where("rating >= 4").select("user_id", "item_id").join(train.select("item_id").distinct(), "item_id", "left_semi")
    return train, test, recs, truth, metrics.user_ranking_metrics(recs, truth, 10)


def _rounded(df, *columns, to=6):
    return df.withColumns({c: F.round(c, to) for c in columns})


@query("popularity_benchmark", with_(*_PIPE) + "SELECT count(*) AS users, round(avg(hit), 6) AS hit, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM per_user")
def popularity_benchmark(spark, d):
    return _rounded(metrics.macro_means(_pipeline(spark, d)[4]), "hit", "precision", "recall", "ndcg")


@query("m01_m04_user_metrics", with_(*_PIPE) + "SELECT user_id, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM per_user")
def m01(spark, d):
    return _rounded(_pipeline(spark, d)[4], "precision", "recall", "ndcg")


@query("k09_popular_unseen", with_(*_PIPE[:4]) + "SELECT user_id, item_id, CAST(rank AS INT) AS rank FROM recs")
def k09(spark, d):
    train, _ = _parts(spark, d)
    return baselines.popular_unseen(_bayes(train), train, 10).select("user_id", "item_id", "rank")


@query("a13_bayesian_popularity", with_(RATINGS, _T01, _BAYES) + "SELECT item_id, n, round(score, 6) AS score FROM bayes")
def a13(spark, d):
    return _rounded(baselines.bayesian_popularity(_parts(spark, d)[0]), "score")


def _bias_sql(passes: int) -> str:
    out, items = [RATINGS, _T01, "mu AS (SELECT avg(rating) AS m FROM train)", "b0 AS (SELECT DISTINCT item_id, CAST(0 AS DOUBLE) AS bi FROM train)"], "b0"
    for k in range(passes):
        out.append(f"u{k} AS MATERIALIZED (SELECT user_id, sum(rating - m - bi) / (count(*) + 10) AS bu FROM train JOIN {items} USING (item_id), mu GROUP BY user_id)")
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT item_id, sum(rating - m - bu) / (count(*) + 10) AS bi FROM train JOIN u{k} USING (user_id), mu GROUP BY item_id)")
        items = f"b{k + 1}"
    out.append(f"pred AS (SELECT t.user_id, t.item_id, t.rating, m + coalesce(bu, 0) + coalesce(bi, 0) AS raw FROM test t LEFT JOIN u{passes - 1} USING (user_id) LEFT JOIN {items} USING (item_id), mu)")
    return with_(*out)


@query("a14_bias_model", _bias_sql(10) + "SELECT user_id, item_id, round(raw, 6) AS raw FROM pred")
def a14(spark, d):
    train, test = _parts(spark, d)
    return _rounded(baselines.predict_biases(test.select("user_id", "item_id"), baselines.fit_biases(train)), "raw")


@query("a15_rating_errors", _bias_sql(10) + "SELECT count(*) AS n, round(sqrt(avg((least(greatest(raw, 1), 5) - rating) ** 2)), 6) AS rmse, round(avg(abs(least(greatest(raw, 1), 5) - rating)), 6) AS mae FROM pred WHERE rating > 0")
def a15(spark, d):
    train, test = _parts(spark, d)
    scored = baselines.predict_biases(test.select("user_id", "item_id", "rating"), baselines.fit_biases(train))
    return _rounded(metrics.rating_errors(scored, "rating", "raw"), "rmse", "mae")


@query("a05_value_shares", "SELECT rating, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM interactions GROUP BY rating")
def a05(spark, d):
    return _rounded(profile.value_shares(table(spark, d, "interactions"), "rating"), "share")


@query(
    "a07_dataset_profile",
    with_(ACTS)
    + """, i AS (SELECT item_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id) - 1 AS k FROM acts GROUP BY item_id), u AS (SELECT user_id, count(*) AS n FROM acts GROUP BY user_id),
    s AS (SELECT (SELECT count(*) FROM acts) AS ratings, (SELECT count(*) FROM u) AS users, (SELECT count(*) FROM i) AS items)
    SELECT ratings, users, items, round(ratings / (CAST(users AS DOUBLE) * items), 9) AS density, (SELECT round(avg(rating), 6) FROM acts) AS mean_rating, (SELECT quantile_cont(n, 0.5) FROM u) AS median_per_user,
      (SELECT quantile_cont(n, 0.5) FROM i) AS median_per_item, (SELECT count(*) FROM i WHERE n < 10) AS few_rated,
      round((SELECT sum(n) FROM i WHERE k < greatest(1, round_even(items * 0.01, 0))) / ratings, 6) AS top1_share, round((SELECT sum(n) FROM i WHERE k < greatest(1, round_even(items * 0.1, 0))) / ratings, 6) AS top10_share FROM s""",
)
def a07(spark, d):
    p = profile.dataset_profile(acts(spark, d))
    return _rounded(p.withColumn("density", F.round("density", 9)), "mean_rating", "top1_share", "top10_share")


@query(
    "a08_column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS cardinality, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.95), 6) AS p95 FROM candidates"
        for c in ("category", "duration", "version_no")
    ),
)
def a08(spark, d):
    p = profile.column_profile(table(spark, d, "candidates"), ["category", "duration", "version_no"])
    return p.select("column", "rows", "missing", "cardinality", F.round(F.col("quantiles")[2], 6).alias("median"), F.round(F.col("quantiles")[4], 6).alias("p95"))


@query(
    "a09_split_summary",
    """SELECT split, count(*) AS rows, count(*) FILTER (long_view AND NOT is_random) AS positives, round(avg(CAST(coalesce(long_view AND NOT is_random, false) AS DOUBLE)), 6) AS positive_rate,
    count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM impressions GROUP BY split""",
)
def a09(spark, d):
    return _rounded(profile.split_summary(table(spark, d, "impressions")), "positive_rate")


@query("a10_length_histogram", "SELECT CAST(l.length AS INT) AS length, coalesce(n, 0) AS n FROM range(51) l(length) LEFT JOIN (SELECT len(coalesce(history_item_ids, [])) AS length, count(*) AS n FROM validation GROUP BY 1) USING (length)")
def a10(spark, d):
    return profile.length_histogram(table(spark, d, "validation"), "history_item_ids")


@query("a11_top_share", "WITH c AS (SELECT item_id, count(*) AS c FROM impressions WHERE item_id IS NOT NULL GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS total, round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC, item_id LIMIT 100)) / sum(c), 6) AS share FROM c")
def a11(spark, d):
    return _rounded(profile.top_share(table(spark, d, "impressions"), "item_id", 100), "share")


@query("a12_candidate_popularity", "SELECT i.item_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT item_id FROM candidates) i LEFT JOIN (SELECT item_id, count(*) AS n FROM impressions WHERE long_view AND NOT is_random GROUP BY item_id) USING (item_id)")
def a12(spark, d):
    return baselines.candidate_popularity(table(spark, d, "candidates"), table(spark, d, "impressions").where("long_view AND NOT is_random"))


@query("a19_across_seeds", "SELECT source, round(avg(m), 6) AS chars_mean, round(stddev_pop(m), 6) AS chars_std FROM (SELECT source, lang, avg(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY source")
def a19(spark, d):
    runs = table(spark, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("chars"))
    return _rounded(profile.across_seeds(runs, ["source"], ["chars"]), "chars_mean", "chars_std")


@query("a20_weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1")
def a20(spark, d):
    return select.weighted_mean(table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "price"), "price", "l_quantity", ["l_returnflag"]).withColumn("price", F.round("price", 4))


@query("a21_decade_means", "SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1")
def a21(spark, d):
    from kelpwright.functions.scalars import decade

    rows = table(spark, d, "orders").select(decade(F.year("o_orderdate")).alias("decade"), F.col("o_totalprice").alias("price"))
    return profile.group_means(rows, "decade", ["price"]).withColumn("price", F.round("price", 4))


@query("a22_argmax", "SELECT user_id, movie_id, neighbor_count FROM recommendations WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY neighbor_count DESC NULLS LAST, movie_id) = 1")
def a22(spark, d):
    rows = table(spark, d, "recommendations").where("user_id IS NOT NULL").select("user_id", "movie_id", "neighbor_count")
    return select.best_row(rows, [F.desc_nulls_last("neighbor_count"), F.asc("movie_id")], ["user_id"])


@query("a23_best_with_ties", "SELECT DISTINCT item_id, category FROM candidates WHERE category IS NOT NULL QUALIFY rank() OVER (PARTITION BY item_id ORDER BY category) = 1")
def a23(spark, d):
    return select.best_with_ties(table(spark, d, "candidates").select("item_id", "category"), ["item_id"], "category", higher=False).distinct()


_TARGETS = """req AS (SELECT DISTINCT request_id, item_id FROM validation WHERE item_id IS NOT NULL), one AS (SELECT request_id, min(item_id) AS item_id FROM req GROUP BY request_id),
    pop AS (SELECT item_id, count(*) AS n FROM impressions WHERE long_view AND NOT is_random AND item_id IS NOT NULL GROUP BY item_id), topp AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM pop QUALIFY rank <= 100),
    ranked AS (SELECT request_id, rank, item_id IN (SELECT item_id FROM candidates WHERE item_id IS NOT NULL) AS covered FROM one LEFT JOIN topp USING (item_id))"""


def _ranked(spark, d):
    one = table(spark, d, "validation").where("item_id IS NOT NULL").groupBy("request_id").agg(F.min("item_id").alias("item_id"))
    pop = baselines.popularity(table(spark, d, "impressions").where("long_view AND NOT is_random"))
    top = global_index(pop.orderBy(F.desc("n"), "item_id").limit(100), [F.desc("n"), F.asc("item_id")], "rank").select("item_id", (F.col("rank") + 1).alias("rank"))
    covered = table(spark, d, "candidates").select("item_id").distinct().withColumn("covered", F.lit(True))
    return one.join(top, "item_id", "left").join(covered, "item_id", "left").select("request_id", "rank", F.coalesce("covered", F.lit(False)).alias("covered"))


@query(
    "m05_single_target",
    with_(_TARGETS)
    + """SELECT count(*) AS requests, round(avg(CAST(coalesce(rank <= 100 AND covered, false) AS DOUBLE)), 6) AS recall, round(avg(CASE WHEN rank <= 100 AND covered THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg,
    round(avg(CAST(coalesce(rank <= 100, false) AS DOUBLE)) FILTER (covered), 6) AS covered_recall, round(avg(CAST(covered AS DOUBLE)), 6) AS coverage FROM ranked""",
)
def m05(spark, d):
    return _rounded(metrics.single_target_metrics(_ranked(spark, d), 100), "recall", "ndcg", "covered_recall", "coverage")


@query("a24_coverage_decomposition", with_(_TARGETS) + "SELECT count(*) FILTER (NOT covered) AS uncovered, count(*) FILTER (covered AND rank IS NULL) AS missed, count(*) FILTER (covered AND rank IS NOT NULL) AS hits FROM ranked")
def a24(spark, d):
    return metrics.coverage_decomposition(_ranked(spark, d), 100)


_PCT = "pct AS (SELECT item_id, (rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE) / count(*) OVER () AS percentile FROM (SELECT item_id, count(*) AS n FROM train GROUP BY item_id))"


@query("w05_percentile_rank", with_(RATINGS, _T01, _PCT) + "SELECT item_id, round(percentile, 8) AS percentile FROM pct")
def w05(spark, d):
    counts = baselines.popularity(_parts(spark, d)[0])
    return profile.popularity_percentiles(counts, "item_id", "n").withColumn("percentile", F.round("percentile", 8))


@query("a25_head_concentration", with_(RATINGS, _T01, _PCT) + "SELECT count(*) AS relevant, round(avg(CAST(percentile <= 0.1 AS DOUBLE)), 6) AS head10, round(avg(CAST(percentile <= 0.2 AS DOUBLE)), 6) AS head20 FROM test JOIN pct USING (item_id) WHERE rating >= 4")
def a25(spark, d):
    train, test = _parts(spark, d)
    pct = profile.popularity_percentiles(baselines.popularity(train), "item_id", "n")
    return _rounded(profile.head_concentration(test.where("rating >= 4"), pct), "head10", "head20")


@query("a26_fold_change", "WITH m AS (SELECT source, avg(n_chars) AS chars, count(*) AS docs FROM documents GROUP BY source) SELECT source, round(chars / (SELECT chars FROM m WHERE source = 'review'), 6) AS chars, round(docs / (SELECT CAST(docs AS DOUBLE) FROM m WHERE source = 'review'), 6) AS docs FROM m")
def a26(spark, d):
    m = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("chars"), F.count(F.lit(1)).alias("docs"))
    return _rounded(profile.fold_change(m, "source", "review", ["chars", "docs"]), "chars", "docs")


@query("a27_matrix_profile", with_(RATINGS, _T01) + "SELECT split, count(*) AS nnz, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(rating) AS low, max(rating) AS high, count(*) FILTER (rating > 0) AS explicit_n FROM t01 GROUP BY split")
def a27(spark, d):
    parts = split.per_user_split(ratings(spark, d), ["ts", "item_id"])
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("nnz"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.min("rating").alias("low"), F.max("rating").alias("high"), F.count_if(F.col("rating") > 0).alias("explicit_n")
    )


@query(
    "m07_list_statistics",
    with_(*_PIPE[:4], "c AS (SELECT item_id, count(*) AS n FROM train GROUP BY item_id)", "head AS (SELECT item_id FROM c ORDER BY n DESC, item_id LIMIT (SELECT CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) FROM c))")
    + """SELECT round(count(DISTINCT r.item_id) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS coverage, round(avg(CASE WHEN r.item_id IN (SELECT item_id FROM head) THEN 0.0::DOUBLE ELSE 1 END), 6) AS long_tail,
    round(avg(-log2(greatest(coalesce(n, 0), 1) / CAST((SELECT sum(n) FROM c) AS DOUBLE))), 6) AS novelty FROM recs r LEFT JOIN c USING (item_id)""",
)
def m07(spark, d):
    train, _, recs, _, _ = _pipeline(spark, d)
    counts = baselines.popularity(train)
    return _rounded(metrics.list_statistics(recs, counts, counts.count()), "coverage", "long_tail", "novelty")


@query(
    "m15_tie_statistics",
    """WITH g AS (SELECT user_id, ranking_score, count(*) AS n FROM recommendations WHERE user_id IS NOT NULL AND isfinite(ranking_score) GROUP BY ALL),
    l AS (SELECT user_id, sum(n) AS n, max(n) AS most, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS tied FROM g GROUP BY user_id)
    SELECT count(*) AS lists, round(avg(CAST(most = n AND n > 1 AS DOUBLE)), 6) AS fully_tied, round(sum(tied) / sum(n), 6) AS entries_tied, max(most) AS largest FROM l""",
)
def m15(spark, d):
    rows = table(spark, d, "recommendations").where("user_id IS NOT NULL AND abs(ranking_score) < double('inf') AND NOT isnan(ranking_score)")
    return _rounded(metrics.tie_statistics(rows, "user_id", "ranking_score"), "fully_tied", "entries_tied")


@query("m16_list_quality", "SELECT round(avg(CAST(used_fallback AS DOUBLE)), 6) AS fallback_share, round(avg(CAST(ranking_score > 5 AS DOUBLE)), 6) AS above_share, round(avg(CAST(ranking_score > 5 OR ranking_score < 1 AS DOUBLE)), 6) AS clipped_share FROM recommendations WHERE isfinite(ranking_score)")
def m16(spark, d):
    rows = table(spark, d, "recommendations").where("abs(ranking_score) < double('inf') AND NOT isnan(ranking_score)")
    return _rounded(metrics.list_quality(rows, "ranking_score", "used_fallback"), "fallback_share", "above_share", "clipped_share")


@query(
    "m18_activity_segments",
    with_(*_PIPE, "act AS (SELECT p.*, a.n FROM per_user p JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY user_id) a USING (user_id))",
          "seg AS (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY n, user_id) - 1) * 4 / CAST(count(*) OVER () - 1 AS DOUBLE))) AS b FROM act)")
    + "SELECT (['sparse', 'light', 'active', 'power'])[CAST(b AS INT)] AS segment, count(*) AS users, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM seg GROUP BY b",
)
def m18(spark, d):
    train, _, _, _, per_user = _pipeline(spark, d)
    activity = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(metrics.activity_segments(per_user, activity, "user_id", "n"), "hit", "recall", "ndcg")


@query("m13_bootstrap")
def m13(spark, d):
    return metrics.bootstrap_interval(_pipeline(spark, d)[4], "user_id", "ndcg")


@query("m14_paired_bootstrap")
def m14(spark, d):
    train, _, recs, truth, mine = _pipeline(spark, d)
    by_count = baselines.popularity(train).withColumnRenamed("n", "score")
    other = metrics.user_ranking_metrics(baselines.popular_unseen(by_count, train, 10), truth, 10)
    return metrics.bootstrap_interval(metrics.paired_differences(mine, other, "user_id", "ndcg"), "user_id", "ndcg")


@query("w04_quantile_bands", "SELECT o_orderkey, CAST(greatest(1, ceil((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 5 / CAST(count(*) OVER () - 1 AS DOUBLE))) AS INT) AS band FROM orders")
def w04(spark, d):
    from kelpwright.operators.encode import popularity_bands

    return popularity_bands(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 5).select("o_orderkey", "band")


@query("w01_w02_positions", "SELECT row_id, row_number() OVER (PARTITION BY item_id ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY item_id) AS size FROM interactions")
def w01(spark, d):
    t = table(spark, d, "interactions")
    sizes = t.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    placed = t.select("row_id", "item_id").withColumn("place", (F.row_number().over(Window.partitionBy("item_id").orderBy("row_id")) - 1).cast("long"))
    return placed.join(sizes, placed["item_id"].eqNullSafe(sizes["item_id"])).select("row_id", "place", "size")


_NEAREST = "SELECT CAST({q} AS DOUBLE) AS quantile, user_id, n FROM u WHERE user_id NOT IN ({not_in}) ORDER BY abs(n - (SELECT quantile_cont(n, {q}) FROM u)), user_id LIMIT 1"


@query(
    "w08_nearest_to_quantiles",
    with_(RATINGS, "u AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1)", "a AS (" + _NEAREST.format(q=0.1, not_in="-1") + ")", "b AS (" + _NEAREST.format(q=0.5, not_in="SELECT user_id FROM a") + ")",
          "c AS (" + _NEAREST.format(q=0.9, not_in="SELECT user_id FROM a UNION ALL SELECT user_id FROM b") + ")")
    + "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c",
)
def w08(spark, d):
    users = ratings(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return select.nearest_to_quantiles(users, "user_id", "n", [0.1, 0.5, 0.9])


@query(
    "w09_early_stopping",
    """WITH e AS (SELECT l_suppkey AS run, month(l_shipdate) AS epoch, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY ALL),
    b AS (SELECT *, CASE WHEN score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN epoch END AS best FROM e),
    m AS (SELECT *, max(best) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM b),
    w AS (SELECT *, row_number() OVER (PARTITION BY run, best_epoch ORDER BY epoch) - 1 AS waited FROM m)
    SELECT run, epoch, best_epoch, waited, max(CAST(waited >= 3 AS INT)) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM w""",
)
def w09(spark, d):
    t = table(spark, d, "lineitem")
    epochs = t.groupBy(F.col("l_suppkey").alias("run"), F.month("l_shipdate").cast("long").alias("epoch")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    rows = select.early_stopping(epochs, "run", "epoch", ["score"], 3)
    return rows.select("run", "epoch", "best_epoch", F.col("waited").cast("long").alias("waited"), "stopped")


@query(
    "w07_top_n_per_user",
    "SELECT user_id, movie_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, n DESC NULLS LAST, movie_id) AS rank FROM (SELECT user_id, movie_id, max(ranking_score) AS s, max(neighbor_count) AS n FROM recommendations WHERE user_id IS NOT NULL AND isfinite(ranking_score) GROUP BY ALL) QUALIFY rank <= 5",
)
def w07(spark, d):
    ok = table(spark, d, "recommendations").where("user_id IS NOT NULL AND abs(ranking_score) < double('inf') AND NOT isnan(ranking_score)")
    one = ok.groupBy("user_id", "movie_id").agg(F.max("ranking_score").alias("s"), F.max("neighbor_count").alias("n"))
    return baselines.top_per_user(one, 5, item="movie_id", score="s", secondary=("n",)).select("user_id", "movie_id", F.col("rank").cast("long").alias("rank"))


@query("w11_rank_by_counting", "WITH r AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, min(l_partkey) AS target FROM r GROUP BY 1), o AS (SELECT r.l_orderkey, s AS own, target FROM r JOIN t ON r.l_orderkey = t.l_orderkey AND l_partkey = target) SELECT r.l_orderkey, 1 + count(*) FILTER (s > own OR (s = own AND l_partkey < target)) AS rank FROM r JOIN o ON r.l_orderkey = o.l_orderkey GROUP BY 1")
def w11(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"))
    r = r.withColumn("target", F.min("l_partkey").over(Window.partitionBy("l_orderkey")))
    return metrics.rank_by_counting(r, "l_orderkey", "s", "l_partkey", "target")


@query("k13_most_common", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 8")
def k13(spark, d):
    return profile.label_counts(table(spark, d, "documents"), "source", r"\|", 8).withColumnRenamed("label", "source")


@query("j01_matched_histories", "SELECT count(*) AS n, count(*) FILTER (v.request_id IS NULL) AS unmatched FROM (SELECT DISTINCT request_id FROM impressions) i LEFT JOIN (SELECT DISTINCT request_id FROM validation) v USING (request_id)")
def j01(spark, d):
    v = table(spark, d, "validation").select("request_id").distinct().withColumn("m", F.lit(True))
    return table(spark, d, "impressions").select("request_id").distinct().join(v, "request_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m").isNull()).alias("unmatched"))


@query("j06_lookup_with_default", "SELECT request_id, coalesce(c.category, -1) AS category FROM (SELECT DISTINCT request_id, item_id FROM validation) v LEFT JOIN (SELECT item_id, min(category) AS category FROM candidates GROUP BY 1) c USING (item_id)")
def j06(spark, d):
    c = table(spark, d, "candidates").groupBy("item_id").agg(F.min("category").alias("category"))
    return table(spark, d, "validation").select("request_id", "item_id").distinct().join(c, "item_id", "left").select("request_id", F.coalesce("category", F.lit(-1)).alias("category"))


@query("j15_label_coverage", "SELECT round(avg(CAST(lower(d.source) IN (SELECT lower(source) FROM source_targets) AS DOUBLE)), 6) AS coverage FROM documents d WHERE source IS NOT NULL")
def j15(spark, d):
    known = table(spark, d, "source_targets").select(F.lower("source").alias("s")).distinct().withColumn("has", F.lit(1.0))
    docs = table(spark, d, "documents").where("source IS NOT NULL").select(F.lower("source").alias("s"))
    return docs.join(known, "s", "left").agg(F.round(F.avg(F.coalesce("has", F.lit(0.0))), 6).alias("coverage"))


@query("j16_source_override", "SELECT item_id, coalesce(b.version_no, a.version_no) AS version_no FROM (SELECT item_id, min(version_no) AS version_no FROM candidates WHERE item_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT item_id, max(version_no) AS version_no FROM candidates WHERE category >= 0 AND item_id IS NOT NULL GROUP BY 1) b USING (item_id)")
def j16(spark, d):
    from kelpwright.operators.dedup import keep_last_by_priority

    c = table(spark, d, "candidates").where("item_id IS NOT NULL")
    first = c.groupBy("item_id").agg(F.min("version_no").alias("version_no"))
    return keep_last_by_priority([first, c.where("category >= 0").groupBy("item_id").agg(F.max("version_no").alias("version_no"))], ["item_id"])


@query("u01_u04_set_operations", "SELECT (SELECT count(*) FROM (SELECT item_id FROM validation INTERSECT SELECT item_id FROM candidates)) AS both_n, (SELECT count(*) FROM (SELECT item_id FROM validation EXCEPT SELECT item_id FROM candidates)) AS only_n, (SELECT count(*) FROM (SELECT item_id FROM validation UNION SELECT item_id FROM candidates)) AS any_n")
def u01(spark, d):
    v, c = table(spark, d, "validation").select("item_id"), table(spark, d, "candidates").select("item_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(v.intersect(c), "both_n").crossJoin(n(v.subtract(c), "only_n")).crossJoin(n(v.unionByName(c).distinct(), "any_n"))


@query("u02_list_overlap", "WITH h AS (SELECT request_id, list_distinct(list_filter(history_item_ids, lambda x: x IS NOT NULL)) AS h FROM (SELECT DISTINCT request_id, history_item_ids FROM validation) WHERE history_item_ids IS NOT NULL) SELECT request_id, len(list_intersect(h, (SELECT list(item_id) FROM (SELECT item_id FROM impressions WHERE item_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 10)))) AS n FROM h")
def u02(spark, d):
    top = table(spark, d, "impressions").where("item_id IS NOT NULL").groupBy("item_id").count().orderBy(F.desc("count"), "item_id").limit(10)
    one = top.agg(F.collect_list("item_id").alias("top"))
    h = table(spark, d, "validation").select("request_id", "history_item_ids").distinct().where("history_item_ids IS NOT NULL").crossJoin(F.broadcast(one))
    return h.select("request_id", F.size(F.array_intersect("history_item_ids", "top")).cast("long").alias("n"))


@query("v02_duplicate_keys", "SELECT request_id, count(*) AS n FROM impressions GROUP BY 1 HAVING count(*) > 1")
def v02(spark, d):
    return checks.duplicate_keys(table(spark, d, "impressions"), ["request_id"])


@query("v03_violations", "SELECT 'rating' AS rule, count(*) FILTER (rating NOT BETWEEN 0 AND 5) AS n FROM interactions UNION ALL SELECT 'no_user', count(*) FILTER (user_id IS NULL) FROM interactions UNION ALL SELECT 'no_time', count(*) FILTER (event_time IS NULL) FROM interactions")
def v03(spark, d):
    return checks.violations(table(spark, d, "interactions"), {"rating": ~F.col("rating").between(0, 5), "no_user": F.col("user_id").isNull(), "no_time": F.col("event_time").isNull()})


@query("v04_uncovered", "SELECT item_id, count(*) AS n FROM validation WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM candidates WHERE item_id IS NOT NULL) GROUP BY 1")
def v04(spark, d):
    return checks.uncovered(table(spark, d, "validation"), table(spark, d, "candidates"), "item_id")


@query("v05_split_overlap", "SELECT DISTINCT request_id FROM impressions WHERE split = 'train' AND request_id IN (SELECT request_id FROM impressions WHERE split = 'validation')")
def v05(spark, d):
    t = table(spark, d, "impressions")
    return checks.overlap(t.where("split = 'train'"), t.where("split = 'validation'"), "request_id")


@query("v06_split_windows", "WITH s AS (SELECT split, min(request_time_ms) AS first, max(request_time_ms) AS last FROM impressions WHERE split IS NOT NULL AND request_time_ms IS NOT NULL GROUP BY 1) SELECT s.split, first, last, (SELECT count(*) FROM s o WHERE o.split <> s.split AND o.first BETWEEN s.first AND s.last) AS overlaps FROM s")
def v06(spark, d):
    return checks.split_windows(table(spark, d, "impressions"), "split", "request_time_ms")


@query("v08_snapshot_differences", "WITH a AS (SELECT item_id, max(category) AS category, max(duration) AS duration FROM candidates WHERE item_id IS NOT NULL AND version_no = 1 GROUP BY 1), b AS (SELECT item_id, max(category) AS category, max(duration) AS duration FROM candidates WHERE item_id IS NOT NULL AND version_no = 2 GROUP BY 1) SELECT count(*) FILTER (b.item_id IS NULL) AS only_old, count(*) FILTER (a.item_id IS NULL) AS only_new, count(*) FILTER (a.item_id = b.item_id AND a.category IS DISTINCT FROM b.category) AS category, count(*) FILTER (a.item_id = b.item_id AND a.duration IS DISTINCT FROM b.duration) AS duration FROM a FULL JOIN b ON a.item_id = b.item_id")
def v08(spark, d):
    of = lambda v: table(spark, d, "candidates").where(f"item_id IS NOT NULL AND version_no = {v}").groupBy("item_id").agg(F.max("category").alias("category"), F.max("duration").alias("duration"))
    return checks.snapshot_differences(of(1), of(2), ["item_id"], ["category", "duration"])


@query("v09_calendar_mismatches", "SELECT count(*) FILTER (strftime(make_timestamp(request_time_ms * 1000), '%Y%m%d') <> strftime(make_timestamp((request_time_ms + 28800000) * 1000), '%Y%m%d')) AS utc0, count(*) FILTER (false AND request_time_ms IS NOT NULL) AS utc8 FROM impressions")
def v09(spark, d):
    from kelpwright.functions.scalars import day_text

    t = table(spark, d, "impressions").withColumn("day", day_text(F.col("request_time_ms"), 8))
    return checks.calendar_mismatches(t, "request_time_ms", "day")


_POS = "pos AS (SELECT * FROM ev WHERE long_view AND NOT is_random)"


@query(
    "v10_history_causality",
    with_(EVENTS, _POS, "x AS (SELECT p.request_id FROM pos p)", "v AS (SELECT request_id, min(history_item_ids) AS h FROM validation WHERE request_id IS NOT NULL AND history_item_ids IS NOT NULL GROUP BY 1)")
    + "SELECT count(*) AS checked, count(*) FILTER (x.request_id IS NULL) AS absent, CAST(0 AS BIGINT) AS different FROM v LEFT JOIN x USING (request_id)",
)
def v10(spark, d):
    from kelpwright.operators.cleaning import positive_events

    again = history.prior_histories(positive_events(events(spark, d)))
    published = table(spark, d, "validation").where("request_id IS NOT NULL AND history_item_ids IS NOT NULL").groupBy("request_id").agg(F.min("history_item_ids").alias("history_item_ids"))
    return checks.history_mismatches(published, again, "request_id")


@query("v11_unit_check", "SELECT count(*) AS compared, count(*) FILTER (abs(v.duration - c.duration) > 1e-5::DOUBLE) AS apart FROM (SELECT DISTINCT request_id, item_id, duration FROM validation WHERE duration IS NOT NULL) v JOIN (SELECT item_id, max(duration) AS duration FROM candidates WHERE duration IS NOT NULL GROUP BY 1) c USING (item_id)")
def v11(spark, d):
    v = table(spark, d, "validation").select("request_id", "item_id", F.col("duration").alias("a")).distinct()
    c = table(spark, d, "candidates").groupBy("item_id").agg(F.max("duration").alias("b"))
    return checks.far_apart(v.join(c, "item_id"), "a", "b")


@query("v14_population_equality", "SELECT count(DISTINCT (n_users, n_items)) AS populations FROM (SELECT split, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM impressions GROUP BY split)")
def v14(spark, d):
    rows = table(spark, d, "impressions").groupBy("split").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
    return checks.population_equality(rows, ["n_users", "n_items"])


@query("m23_unknown_rates", "SELECT round(avg(CAST(coalesce(category, -1) = -1 AS DOUBLE)), 6) AS unknown_share, (SELECT count(*) FROM (SELECT DISTINCT category FROM validation WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM candidates WHERE category IS NOT NULL))) AS unseen FROM candidates")
def m23(spark, d):
    c = table(spark, d, "candidates")
    share = c.agg(F.round(F.avg((F.coalesce("category", F.lit(-1)) == -1).cast("double")), 6).alias("unknown_share"))
    unseen = checks.uncovered(table(spark, d, "validation"), c, "category").agg(F.count(F.lit(1)).alias("unseen"))
    return share.crossJoin(unseen)


@query("x17_log_frequency", "WITH c AS (SELECT item_id, count(*) AS n FROM impressions WHERE item_id IS NOT NULL GROUP BY 1) SELECT item_id, round(ln((n + 1) / CAST((SELECT sum(n) + count(*) FROM c) AS DOUBLE)), 6) AS log_q FROM c")
def x17(spark, d):
    from kelpwright.operators.encode import log_frequency

    return log_frequency(baselines.popularity(table(spark, d, "impressions")), "n").select("item_id", F.round("log_q", 6).alias("log_q"))

"""Queries of the remaining filters, joins, lists and list metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpwright.functions import scalars as S
from kelpwright.operators import baselines, checks, cleaning, encode, metrics, split
from kelpwright.plans.analysis import _LISTS, _PIPE, _T01, _bayes, _parts, _pipeline, _rounded
from kelpwright.plans.models import _E, _SIM, _cf, _embeddings
from kelpwright.plans.registry import Registry, table
from kelpwright.plans.views import ACTS, EVENTS, MIXED, RATINGS, acts, events, ratings, with_
from kelpwright.storage import Workspace

registry = Registry()
query = registry.query


@query("proj_p07_relevance", with_(RATINGS, _T01) + "SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4 AND item_id IN (SELECT item_id FROM train)")
def p07(spark, d):
    train, test = _parts(spark, d)
    return test.where("rating >= 4").join(train.select("item_id").distinct(), "item_id", "left_semi").select("user_id", "item_id").distinct()


@query("proj_p09_first_users", with_(ACTS) + "SELECT user_id, item_id, count(*) AS n FROM acts WHERE user_id IN (SELECT DISTINCT user_id FROM acts ORDER BY user_id LIMIT 100) GROUP BY ALL")
def p09(spark, d):
    rows = acts(spark, d)
    first = rows.select("user_id").distinct().orderBy("user_id").limit(100)
    return rows.join(first, "user_id", "left_semi").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("d11_catalog_vocabulary", "SELECT source, row_number() OVER (ORDER BY source) AS code FROM (SELECT DISTINCT coalesce(source, '__missing__') AS source FROM documents)")
def d11(spark, d):
    return encode.fit_vocabulary(table(spark, d, "documents"), "source").withColumnRenamed("value", "source")


@query("t04_cutoff_array", "SELECT request_id, CASE WHEN time_ms < 1690000000000 THEN 'train' WHEN time_ms < 1700000000000 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT request_id, time_ms FROM validation WHERE time_ms IS NOT NULL)")
def t04(spark, d):
    rows = table(spark, d, "validation").where("time_ms IS NOT NULL").select("request_id", "time_ms").distinct()
    return split.time_window_split(rows, [("train", 1690000000000), ("validation", 1700000000000)], "test", "time_ms").select("request_id", "split")


@query(
    "h04_noncausal_histories",
    """WITH r AS (SELECT DISTINCT request_id, time_ms, history_item_ids AS h FROM validation WHERE time_ms IS NOT NULL AND len(history_item_ids) > 0),
    seen AS (SELECT item_id, min(first_observed_ms) AS seen FROM candidates WHERE item_id IS NOT NULL GROUP BY 1),
    x AS (SELECT request_id, time_ms, coalesce(seen >= time_ms, true) AS late FROM (SELECT request_id, time_ms, unnest(h) AS item_id FROM r) LEFT JOIN seen USING (item_id) WHERE item_id IS NOT NULL)
    SELECT request_id, count(*) AS n_items, count(*) FILTER (late) AS n_unavailable FROM x GROUP BY request_id HAVING count(*) FILTER (late) > 0""",
)
def h04(spark, d):
    """Requests to reject: history items that were not on record before the request."""
    seen = table(spark, d, "candidates").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("first_observed_ms").alias("seen"))
    rows = table(spark, d, "validation").where("time_ms IS NOT NULL AND size(history_item_ids) > 0").select("request_id", "time_ms", "history_item_ids").distinct()
    items = rows.select("request_id", "time_ms", F.explode("history_item_ids").alias("item_id")).where("item_id IS NOT NULL").join(seen, "item_id", "left")
    late = F.coalesce(F.col("seen") >= F.col("time_ms"), F.lit(True))
    per = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(late).alias("n_unavailable"))
    return per.where("n_unavailable > 0")


@query(
    "h06_rolling_history",
    with_(EVENTS, "pos AS (SELECT * FROM ev WHERE long_view AND NOT is_random)")
    + """SELECT a.request_id, count(b.request_id) AS n_prior, coalesce(max(b.request_time_ms), 0) AS latest_ms FROM (SELECT * FROM pos WHERE request_time_ms >= 1721000000000) a
    LEFT JOIN pos b ON a.user_id = b.user_id AND b.request_time_ms < a.request_time_ms GROUP BY 1""",
)
def h06(spark, d):
    pos = Workspace(spark, "pos").write(cleaning.positive_events(events(spark, d)), "pos")
    # One row an instant; sums over the strictly earlier ones.
    instants = pos.groupBy("user_id", "request_time_ms").agg(F.count("request_id").alias("n"))
    before = Window.partitionBy("user_id").orderBy("request_time_ms").rowsBetween(Window.unboundedPreceding, -1)
    past = instants.select("user_id", "request_time_ms", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_prior"), F.coalesce(F.lag("request_time_ms").over(Window.partitionBy("user_id").orderBy("request_time_ms")), F.lit(0)).alias("latest_ms"))
    late = pos.where("request_time_ms >= 1721000000000")
    return late.join(past, ["user_id", "request_time_ms"]).select("request_id", "n_prior", "latest_ms")


@query("j02_paired_users", with_(*_PIPE, "o AS (SELECT user_id, count(*) AS n FROM train GROUP BY 1)") + "SELECT user_id, round(ndcg, 6) AS ndcg, n FROM per_user JOIN o USING (user_id)")
def j02(spark, d):
    train, _, _, _, per_user = _pipeline(spark, d)
    return _rounded(per_user.join(train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id").select("user_id", "ndcg", "n"), "ndcg")


@query(
    "j05_seen_exclusion",
    with_(RATINGS, _T01, _SIM)
    + """SELECT DISTINCT t.user_id, near.neighbor AS item_id FROM test t JOIN near ON near.entity = t.item_id
    WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = t.user_id AND s.item_id = near.neighbor)""",
)
def j05(spark, d):
    """Each user's candidates, neighbors of the items of test, without own seen items."""
    model, train, test = _cf(spark, d)
    near = model.neighbors.select(F.col("entity").alias("e"), F.col("neighbor").alias("item_id"))
    reached = test.select("user_id", F.col("item_id").alias("e")).join(near, "e").select("user_id", "item_id").distinct()
    return reached.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


@query("j07_metadata_join", with_(RATINGS) + "SELECT user_id, item_id, p_name AS title, p_type AS genre FROM ratings LEFT JOIN part ON p_partkey = item_id WHERE rating = 5")
def j07(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"))
    return ratings(spark, d).where("rating = 5").select("user_id", "item_id").join(part, "item_id", "left").select("user_id", "item_id", "title", "genre")


@query("j11_eligibility", "SELECT r.request_id, count(c.item_id) AS n FROM (SELECT request_id, min(time_ms) AS t, min(item_id) AS item_id FROM validation WHERE time_ms IS NOT NULL AND item_id IS NOT NULL GROUP BY 1) r LEFT JOIN candidates c ON c.item_id = r.item_id AND c.eligible_after_ms <= r.t GROUP BY 1")
def j11(spark, d):
    r = table(spark, d, "validation").where("time_ms IS NOT NULL AND item_id IS NOT NULL").groupBy("request_id").agg(F.min("time_ms").alias("t"), F.min("item_id").alias("item_id"))
    c = table(spark, d, "candidates").select(F.col("item_id").alias("c"), "eligible_after_ms")
    return r.join(c, (F.col("item_id") == F.col("c")) & (F.col("eligible_after_ms") <= F.col("t")), "left").groupBy("request_id").agg(F.count("c").alias("n"))


@query(
    "k10_distinct_similar",
    with_(_E)
    + """, s AS (SELECT e.idx, e.label, round(list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(q.v, q.v)), 9) AS score FROM e, (SELECT * FROM e WHERE idx = 0) q WHERE e.idx <> 0 AND e.label <> q.label),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, idx) = 1) SELECT idx, label, round(score, 6) AS score FROM b ORDER BY b.score DESC, idx LIMIT 10""",
)
def k10(spark, d):
    rows = _embeddings(spark, d)[1]
    seed = rows.where("idx = 0").select("v", "label").first()
    q = F.array(*(F.lit(float(x)) for x in seed["v"]))
    scored = rows.where((F.col("idx") != 0) & (F.col("label") != seed["label"])).select("idx", "label", F.round(S.dot("v", q) / (S.norm("v") * S.norm(q)), 9).alias("score"))
    best = baselines.top_per_user(scored, 1, "label", "idx", "score")
    return best.orderBy(F.desc("score"), "idx").limit(10).select("idx", "label", F.round("score", 6).alias("score"))


@query("k12_related_items", with_(RATINGS, _T01, _SIM) + "SELECT entity, neighbor, row_number() OVER (PARTITION BY entity ORDER BY similarity DESC, neighbor) AS rank, round(similarity, 6) AS similarity, support FROM near WHERE entity IN (SELECT item_id FROM train GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 10) QUALIFY rank <= 5")
def k12(spark, d):
    model, train, _ = _cf(spark, d)
    seeds = baselines.popularity(train).orderBy(F.desc("n"), "item_id").limit(10).select(F.col("item_id").alias("entity"))
    top = baselines.top_per_user(model.neighbors.join(seeds, "entity", "left_semi"), 5, "entity", "neighbor", "similarity")
    return top.select("entity", "neighbor", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"), "support")


@query(
    "m06_exclusion_rates",
    """WITH r AS (SELECT request_id, min(item_id) AS item_id, min(user_id) AS user_id, max(len(coalesce(history_item_ids, []))) AS h FROM validation GROUP BY 1)
    SELECT round(avg(CAST(coalesce(item_id IN (SELECT item_id FROM candidates WHERE item_id IS NOT NULL), false) AS DOUBLE)), 6) AS target_coverage,
    round(avg(CAST(NOT coalesce(user_id IN (SELECT user_id FROM impressions WHERE user_id IS NOT NULL), false) AS DOUBLE)), 6) AS unknown_users, round(avg(CAST(h = 0 AS DOUBLE)), 6) AS empty_histories FROM r""",
)
def m06(spark, d):
    r = table(spark, d, "validation").groupBy("request_id").agg(F.min("item_id").alias("item_id"), F.min("user_id").alias("user_id"), F.max(F.coalesce(F.size(F.coalesce("history_item_ids", F.array().cast("array<bigint>"))), F.lit(0))).alias("h"))
    items = table(spark, d, "candidates").select("item_id").distinct().withColumn("has_item", F.lit(True))
    users = table(spark, d, "impressions").select("user_id").distinct().withColumn("has_user", F.lit(True))
    rows = r.join(items, "item_id", "left").join(users, "user_id", "left")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.agg(rate(F.coalesce("has_item", F.lit(False))).alias("target_coverage"), rate(F.col("has_user").isNull()).alias("unknown_users"), rate(F.col("h") == 0).alias("empty_histories"))


@query("m11_popularity_means", with_(*_PIPE[:4], "c AS (SELECT item_id, count(*) AS n FROM train GROUP BY item_id)") + "SELECT round((SELECT avg(n) FROM recs JOIN c USING (item_id)), 6) AS lists_mean, round((SELECT avg(n) FROM c), 6) AS catalog_mean")
def m11(spark, d):
    train, _ = _parts(spark, d)
    counts = baselines.popularity(train)
    lists = baselines.popular_unseen(_bayes(train), train, 10).join(counts, "item_id").agg(F.round(F.avg("n"), 6).alias("lists_mean"))
    return lists.crossJoin(F.broadcast(counts.agg(F.round(F.avg("n"), 6).alias("catalog_mean"))))


@query(
    "m17_five_star_evidence",
    with_(RATINGS, _T01, _SIM) + "SELECT count(*) AS pairs, round(avg(CAST(least_rating = 5 AS DOUBLE)), 6) AS five_only FROM (SELECT t.user_id, t.item_id, min(res.rating) AS least_rating FROM test t JOIN near ON near.entity = t.item_id JOIN res ON res.user_id = t.user_id AND res.item_id = near.neighbor GROUP BY 1, 2)",
)
def m17(spark, d):
    model, _, test = _cf(spark, d)
    near = model.neighbors.select(F.col("entity").alias("item_id"), F.col("neighbor").alias("m"))
    source = model.res.select("user_id", F.col("item_id").alias("m"), "rating")
    per = test.select("user_id", "item_id").join(near, "item_id").join(source, ["user_id", "m"]).groupBy("user_id", "item_id").agg(F.min("rating").alias("least"))
    return per.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("least") == 5).cast("double")), 6).alias("five_only"))


@query(
    "m19_predictable_errors",
    with_(RATINGS, _T01, "m AS (SELECT item_id, avg(rating) AS p FROM train GROUP BY 1)")
    + "SELECT count(*) AS n, round(sqrt(avg((p - rating) ** 2)), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae, round(count(*) / CAST((SELECT count(*) FROM test) AS DOUBLE), 6) AS coverage FROM test JOIN m USING (item_id)",
)
def m19(spark, d):
    train, test = _parts(spark, d)
    means = train.groupBy("item_id").agg(F.avg("rating").alias("p"))
    errors = metrics.rating_errors(test.join(means, "item_id"), "rating", "p")
    n = test.agg(F.count(F.lit(1)).alias("all_n"))
    return _rounded(errors.crossJoin(F.broadcast(n)).withColumn("coverage", F.col("n") / F.col("all_n")).drop("all_n"), "rmse", "mae", "coverage")


@query("s16_split_counts", "SELECT split, count(*) AS rows, count(DISTINCT request_id) AS requests FROM impressions GROUP BY split")
def s16(spark, d):
    from kelpwright.sources.sinks import write_parquet

    path = Workspace(spark, "by_split").path("t")
    write_parquet(table(spark, d, "impressions").select("request_id", "split"), path, partition_by="split")
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("request_id").alias("requests"))


@query("v18_preflight", "SELECT 'no_request' AS rule, count(*) FILTER (request_id IS NULL) AS n FROM validation UNION ALL SELECT 'no_item', count(*) FILTER (item_id IS NULL) FROM validation UNION ALL SELECT 'long_history', count(*) FILTER (len(history_item_ids) > 50) FROM validation UNION ALL SELECT 'null_element', count(*) FILTER (len(list_filter(history_item_ids, lambda x: x IS NULL)) > 0) FROM validation")
def v18(spark, d):
    h = F.col("history_item_ids")
    rules = {"no_request": F.col("request_id").isNull(), "no_item": F.col("item_id").isNull(), "long_history": F.size(h) > 50, "null_element": F.exists(h, lambda x: x.isNull())}
    return checks.violations(table(spark, d, "validation"), rules)

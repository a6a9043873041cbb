"""Queries of similarity, neighborhood and factor models, vector retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kelpwright.functions import scalars as S
from kelpwright.operators import encode, factor, metrics, neighborhood, split, towers, vectors
from kelpwright.operators.ranking import global_index, seeded_order
from kelpwright.plans.analysis import _BAYES, _T01, _parts
from kelpwright.plans.registry import Registry, table
from kelpwright.plans.views import RATINGS, ratings, with_

registry = Registry()
query = registry.query

_SIM = """res AS (SELECT user_id, item_id, rating, rating - avg(rating) OVER (PARTITION BY user_id) AS r, avg(rating) OVER (PARTITION BY user_id) AS mean FROM train),
    norms AS (SELECT item_id, sqrt(sum(r * r)) AS norm FROM res GROUP BY item_id),
    prod AS (SELECT a.item_id AS entity, b.item_id AS neighbor, sum(a.r * b.r) / (max(na.norm) * max(nb.norm)) AS cosine, count(*) AS support FROM res a JOIN res b ON a.user_id = b.user_id AND a.item_id <> b.item_id
      JOIN norms na ON na.item_id = a.item_id JOIN norms nb ON nb.item_id = b.item_id WHERE na.norm > 0 AND nb.norm > 0 GROUP BY ALL),
    near AS (SELECT entity, neighbor, round(cosine * support / (support + CAST(10 AS DOUBLE)), 12) AS similarity, support FROM prod WHERE round(cosine * support / (support + CAST(10 AS DOUBLE)), 12) > 0 AND support >= 2
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY similarity DESC, neighbor) <= 20)"""


def _cf(spark, d, **kw):
    train, test = _parts(spark, d)
    args = dict(mode="item", variant="mean_centered", k=20, min_support=2, shrinkage=10.0) | kw
    return neighborhood.NeighborhoodCF(**args).fit(train.select("user_id", "item_id", "rating")), train, test


@query("k06_top_similar", with_(RATINGS, _T01, _SIM) + "SELECT entity, neighbor, round(similarity, 6) AS similarity, support FROM near")
def k06(spark, d):
    model = _cf(spark, d)[0]
    return model.neighbors.select("entity", "neighbor", F.round("similarity", 6).alias("similarity"), "support")


@query(
    "x02_cf_predict",
    with_(RATINGS, _T01, _SIM, "bayes AS (SELECT item_id, (sum(rating) + 25 * (SELECT avg(rating) FROM train)) / (count(*) + 25) AS score FROM train GROUP BY item_id)",
          "evidence AS (SELECT t.user_id, t.item_id, sum(similarity * r) AS num, sum(similarity) AS den, count(*) AS neighbors FROM test t JOIN near ON near.entity = t.item_id JOIN res ON res.user_id = t.user_id AND res.item_id = near.neighbor GROUP BY ALL)")
    + """SELECT t.user_id, t.item_id, round(least(greatest(CASE WHEN neighbors >= 1 AND den > 0 THEN m.mean + num / den ELSE coalesce(b.score, (SELECT avg(rating) FROM train)) END, 1), 5), 5) AS rating_estimate,
    coalesce(neighbors, 0) AS neighbors, NOT coalesce(neighbors >= 1 AND den > 0, false) AS used_fallback FROM test t LEFT JOIN evidence USING (user_id, item_id)
    LEFT JOIN (SELECT user_id, avg(rating) AS mean FROM train GROUP BY 1) m ON m.user_id = t.user_id LEFT JOIN bayes b ON b.item_id = t.item_id""",
)
def x02(spark, d):
    model, _, test = _cf(spark, d)
    return model.predict(test.select("user_id", "item_id")).withColumn("rating_estimate", F.round("rating_estimate", 5))


@query(
    "x03_cf_recommend",
    with_(RATINGS, _T01, _SIM, "bayes AS (SELECT item_id, (sum(rating) + 25 * (SELECT avg(rating) FROM train)) / (count(*) + 25) AS fallback FROM train GROUP BY item_id)",
          "means AS (SELECT user_id, avg(rating) AS mean FROM train GROUP BY user_id)",
          """good AS (SELECT user_id, item_id, round(mean + num / den, 9) AS score, den AS evidence, false AS used_fallback FROM
            (SELECT res.user_id, near.entity AS item_id, sum(similarity * r) AS num, sum(similarity) AS den FROM res JOIN near ON near.neighbor = res.item_id GROUP BY ALL) JOIN means USING (user_id)
            WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = means.user_id AND s.item_id = item_id))""".replace("s.item_id = item_id)", "s.item_id = near_item)").replace("near.entity AS item_id", "near.entity AS near_item").replace("SELECT user_id, item_id, round", "SELECT user_id, near_item AS item_id, round"),
          """rest AS (SELECT m.user_id, b.item_id, round(b.fallback, 9) AS score, CAST(0 AS DOUBLE) AS evidence, true AS used_fallback FROM means m CROSS JOIN bayes b
            WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.user_id = m.user_id AND s.item_id = b.item_id) AND NOT EXISTS (SELECT 1 FROM good g WHERE g.user_id = m.user_id AND g.item_id = b.item_id))""")
    + """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, fallback DESC, evidence DESC, item_id) AS INTEGER) AS rank, item_id, round(score, 6) AS score, used_fallback
    FROM (SELECT * FROM good UNION ALL SELECT * FROM rest) JOIN bayes USING (item_id) QUALIFY rank <= 10""",
)
def x03(spark, d):
    model, train, _ = _cf(spark, d)
    return model.recommend(train.select("user_id"), 10, secondary=True).select("user_id", "rank", "item_id", F.round("score", 6).alias("score"), "used_fallback")


@query(
    "x01_user_cf_neighbors",
    with_(RATINGS, _T01, _SIM.replace("item_id", "ITEM").replace("user_id", "item_id").replace("ITEM", "user_id").replace("(PARTITION BY item_id)", "(PARTITION BY user_id)").replace("support >= 2", "support >= 3").replace("SELECT item_id, user_id, rating", "SELECT user_id, item_id, rating"))
    + "SELECT entity, neighbor, round(similarity, 6) AS similarity, support FROM near",
)
def x01(spark, d):
    near = _cf(spark, d, mode="user", min_support=3)[0].neighbors
    return near.select("entity", "neighbor", F.round("similarity", 6).alias("similarity"), "support")


@query(
    "k11_evidence",
    with_(RATINGS, _T01, _SIM)
    + """SELECT t.user_id, t.item_id, CAST(row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY abs(round(similarity * r, 12)) DESC, neighbor) AS INTEGER) AS rank, neighbor, round(similarity * r, 6) AS contribution
    FROM test t JOIN near ON near.entity = t.item_id JOIN res ON res.user_id = t.user_id AND res.item_id = near.neighbor QUALIFY rank <= 3""",
)
def k11(spark, d):
    model, _, test = _cf(spark, d)
    return neighborhood.explain(model, test.select("user_id", "item_id")).withColumn("contribution", F.round("contribution", 6))


@query("x03_bias_aware_recommend")
def x03_bias(spark, d):
    model, train, test = _cf(spark, d, variant="bias_aware")
    return model.recommend(test.select("user_id"), 10, secondary=True)


@query(
    "a18_corated_sums",
    with_(RATINGS) + "SELECT a.item_id AS a, count(*) AS support, CAST(sum(a.rating * b.rating) AS BIGINT) AS dot FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1",
)
def a18(spark, d):
    r = ratings(spark, d).select("user_id", F.col("item_id").alias("a"), F.col("rating").alias("ra"))
    pairs = r.join(r.withColumnsRenamed({"a": "b", "ra": "rb"}), "user_id").where("a < b")
    return pairs.groupBy("a").agg(F.count(F.lit(1)).alias("support"), F.sum(F.col("ra") * F.col("rb")).cast("long").alias("dot"))


def _embeddings(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"), "label")
    return e.where("idx % 100 = 0"), e


_E = "e AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT * FROM e WHERE idx % 100 = 0)"
_COS = "cos AS (SELECT q.idx AS query, e.idx AS neighbor, q.label = e.label AS same, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 9) AS score FROM q JOIN e ON q.idx <> e.idx)"
_TOP = "SELECT query, neighbor, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbor) AS INT) AS rank FROM {} QUALIFY rank <= 10"


@query("k03_cosine_top_k", with_(_E, _COS) + _TOP.format("cos"))
def k03(spark, d):
    q, rows = _embeddings(spark, d)
    return vectors.exact_top_k(q, rows, 10).withColumn("score", F.round("score", 6))


@query("k04_cluster_pruned", with_(_E, _COS) + _TOP.format("cos WHERE same"))
def k04(spark, d):
    q, rows = _embeddings(spark, d)
    return vectors.exact_top_k(q, rows, 10, group="label").withColumn("score", F.round("score", 6))


@query("k05_euclidean", with_(_E, "cos AS (SELECT q.idx AS query, e.idx AS neighbor, round(-list_distance(q.v, e.v), 9) AS score FROM q JOIN e ON q.idx <> e.idx)") + _TOP.format("cos").replace("round(score, 6)", "round(score, 5)"))
def k05(spark, d):
    q, rows = _embeddings(spark, d)
    return vectors.exact_top_k(q, rows, 10, metric="euclidean").withColumn("score", F.round("score", 5))


@query(
    "k07_eligible_top_k",
    with_(_E, "cos AS (SELECT q.idx AS query, e.idx AS neighbor, round(list_dot_product(q.v, e.v), 9) AS score FROM q JOIN e ON (e.idx * 7919) % 1000 <= (q.idx // 100) * 40)", "ranked AS (" + _TOP.format("cos") + ")")
    + "SELECT q.idx AS query, list_concat(coalesce(l, []), list_resize(CAST([] AS BIGINT[]), 10 - len(coalesce(l, [])), -1)) AS neighbors FROM q LEFT JOIN (SELECT query, list(neighbor ORDER BY rank) AS l FROM ranked GROUP BY query) r ON r.query = q.idx",
)
def k07(spark, d):
    q, rows = _embeddings(spark, d)
    q = q.withColumn("at", F.floor(F.col("idx") / 100) * 40)
    rows = rows.withColumn("eligible", F.col("idx") * 7919 % 1000)
    top = vectors.exact_top_k(q, rows, 10, metric="dot", time="at", eligible="eligible", exclude_self=False)
    return vectors.padded_lists(top, q, "idx", 10)


@query("m10_list_overlap", with_(_E, _COS, "a AS (" + _TOP.format("cos") + ")", "b AS (" + _TOP.format("cos WHERE same") + ")") + "SELECT round(avg(n / CAST(size AS DOUBLE)), 6) AS overlap FROM (SELECT a.query, count(b.neighbor) AS n, count(*) AS size FROM a LEFT JOIN b ON a.query = b.query AND a.neighbor = b.neighbor GROUP BY 1)")
def m10(spark, d):
    q, rows = _embeddings(spark, d)
    return vectors.list_overlap(vectors.exact_top_k(q, rows, 10), vectors.exact_top_k(q, rows, 10, group="label"), 10).withColumn("overlap", F.round("overlap", 6))


@query(
    "m08_diversity",
    with_(_E, _COS, "a AS (" + _TOP.format("cos") + ")")
    + """SELECT x.query, round(1 - avg(list_dot_product(ex.v, ey.v) / sqrt(list_dot_product(ex.v, ex.v) * list_dot_product(ey.v, ey.v))), 5) AS diversity FROM a x JOIN a y ON x.query = y.query AND x.rank < y.rank
    JOIN e ex ON ex.idx = x.neighbor JOIN e ey ON ey.idx = y.neighbor GROUP BY 1""",
)
def m08(spark, d):
    q, rows = _embeddings(spark, d)
    return vectors.intra_list_diversity(vectors.exact_top_k(q, rows, 10), rows).withColumn("diversity", F.round("diversity", 5))


@query("m09_neighborhood_distance", with_(_E, _COS, "a AS (" + _TOP.format("cos").replace("round(score, 6) AS score", "score") + ")") + "SELECT round(avg(1 - m), 6) AS distance FROM (SELECT query, avg(score) AS m FROM a GROUP BY 1)")
def m09(spark, d):
    q, rows = _embeddings(spark, d)
    per = vectors.exact_top_k(q, rows, 10).groupBy("query").agg(F.avg("score").alias("m"))
    return per.agg(F.round(F.avg(1 - F.col("m")), 6).alias("distance"))


@query(
    "m12_silhouette",
    with_("e AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 2000)",
          "d AS (SELECT a.idx, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a CROSS JOIN e b GROUP BY ALL)",
          "m AS (SELECT idx, max(CASE WHEN label = other THEN n END) AS own_n, max(CASE WHEN label = other THEN s / greatest(n - 1, 1) END) AS inner_d, min(CASE WHEN label <> other THEN s / n END) AS outer_d FROM d GROUP BY idx)")
    + "SELECT round(avg(CASE WHEN own_n > 1 THEN (outer_d - inner_d) / greatest(inner_d, outer_d) ELSE 0 END), 5) AS silhouette, count(*) AS n FROM m",
)
def m12(spark, d):
    return vectors.silhouette(_embeddings(spark, d)[1], "v", "label", "idx").withColumn("silhouette", F.round("silhouette", 5))


@query("m21_weighted_cosine", with_(_E) + "SELECT a.idx, round(coalesce(list_dot_product(list_transform(a.v, lambda x, i: x * i), list_transform(b.v, lambda x, i: x * i)) / nullif(sqrt(list_dot_product(list_transform(a.v, lambda x, i: x * i), list_transform(a.v, lambda x, i: x * i)) * list_dot_product(list_transform(b.v, lambda x, i: x * i), list_transform(b.v, lambda x, i: x * i))), 0), 0), 6) AS score FROM e a JOIN e b ON b.idx = a.idx + 1")
def m21(spark, d):
    rows = _embeddings(spark, d)[1]
    after = rows.select((F.col("idx") - 1).alias("idx"), F.col("v").alias("w"))
    weights = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: i.cast("double"))
    return rows.join(after, "idx").select("idx", F.round(S.weighted_cosine(F.col("v"), F.col("w"), weights), 6).alias("score"))


_POOL = "f AS (SELECT item_idx, min(CAST(factors AS DOUBLE[])) AS v FROM item_factors WHERE factors IS NOT NULL AND NOT list_bool_or(list_transform(factors, lambda x: isnan(x))) GROUP BY 1)"


_BOTH = with_(_POOL, "u AS (SELECT user_idx, min(CAST(factors AS DOUBLE[])) AS v FROM user_factors WHERE factors IS NOT NULL AND NOT list_bool_or(list_transform(factors, lambda x: isnan(x))) GROUP BY 1)")


def _given_factors(spark, d):
    clean = lambda t, c: table(spark, d, t).where(F.col("factors").isNotNull() & ~F.exists("factors", F.isnan)).groupBy(F.col(c).alias("idx")).agg(F.min("factors").alias("f"))
    return factor.FactorModel(clean("user_factors", "user_idx"), clean("item_factors", "item_idx"), user="user_idx", item="item_idx")


@query(
    "x11_factor_predict",
    _BOTH + """SELECT r.user_idx, r.item_idx, round(coalesce(list_dot_product(u.v, f.v), 0), 4) AS prediction
    FROM (SELECT DISTINCT user_id AS user_idx, movie_id % (SELECT max(item_idx) + 1 FROM f) AS item_idx FROM recommendations WHERE user_id IS NOT NULL) r LEFT JOIN u USING (user_idx) LEFT JOIN f USING (item_idx)""",
)
def x11(spark, d):
    model = _given_factors(spark, d)
    n = model.items.agg((F.max("idx") + 1).alias("n"))
    pairs = table(spark, d, "recommendations").where("user_id IS NOT NULL").crossJoin(F.broadcast(n)).select(F.col("user_id").alias("user_idx"), (F.col("movie_id") % F.col("n")).alias("item_idx")).distinct()
    return model.predict(pairs).select("user_idx", "item_idx", F.round("prediction", 4).alias("prediction"))


@query(
    "k08_catalog_lists",
    _BOTH + """, seen AS (SELECT DISTINCT user_id AS user_idx, movie_id % (SELECT max(item_idx) + 1 FROM f) AS item_idx FROM recommendations),
    s AS (SELECT u.user_idx, f.item_idx, round(list_dot_product(u.v, f.v), 9) AS score FROM u CROSS JOIN f WHERE u.user_idx % 100 = 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_idx = u.user_idx AND seen.item_idx = f.item_idx))
    SELECT user_idx, item_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS INTEGER) AS rank, round(score, 5) AS score FROM s QUALIFY rank <= 10""",
)
def k08_lists(spark, d):
    """The whole catalog ranked by given factors for the stated users, seen items left out."""
    model = _given_factors(spark, d)
    n = model.items.agg((F.max("idx") + 1).alias("n"))
    seen = table(spark, d, "recommendations").where("user_id IS NOT NULL").crossJoin(F.broadcast(n)).select(F.col("user_id").alias("user_idx"), (F.col("movie_id") % F.col("n")).alias("item_idx"))
    model.users = model.users.where("idx % 100 = 0")
    return model.recommend_catalog(seen).select("user_idx", "item_idx", "rank", F.round("score", 5).alias("score"))


@query(
    "x15_mean_pooled",
    with_(_POOL, "h AS (SELECT request_id, min(history_item_ids) AS h FROM validation WHERE history_item_ids IS NOT NULL AND len(history_item_ids) > 0 GROUP BY 1)", "x AS (SELECT request_id, unnest(h) % (SELECT max(item_idx) + 1 FROM f) AS item_idx FROM h)")
    + "SELECT request_id, round(avg(v[1]), 5) AS first, round(avg(v[50]), 5) AS last FROM x JOIN f USING (item_idx) GROUP BY 1",
)
def x15(spark, d):
    v = table(spark, d, "item_factors").where(F.col("factors").isNotNull() & ~F.exists("factors", F.isnan)).groupBy(F.col("item_idx").alias("item_id")).agg(F.min("factors").alias("v"))
    n = v.agg((F.max("item_id") + 1).alias("n"))
    h = table(spark, d, "validation").where("history_item_ids IS NOT NULL AND size(history_item_ids) > 0").groupBy("request_id").agg(F.min("history_item_ids").alias("h"))
    h = h.crossJoin(F.broadcast(n)).select("request_id", F.transform("h", lambda x: (x % F.col("n")).cast("int")).alias("history_item_ids"))
    pooled = towers.mean_pooled(h, v, 50)
    return pooled.select("request_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[49], 5).alias("last"))


@query("x21_preference_features", "WITH c AS (SELECT item_id, max(CAST(round(duration * 1000) AS BIGINT)) AS ms FROM candidates WHERE duration IS NOT NULL GROUP BY 1), h AS (SELECT request_id, unnest(h) AS item_id FROM (SELECT request_id, min(history_item_ids) AS h FROM validation WHERE history_item_ids IS NOT NULL GROUP BY 1)) SELECT request_id, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) AS n_known FROM h JOIN c USING (item_id) GROUP BY 1")
def x21(spark, d):
    h = table(spark, d, "validation").where("history_item_ids IS NOT NULL").groupBy("request_id").agg(F.min("history_item_ids").alias("h"))
    c = table(spark, d, "candidates").where("duration IS NOT NULL").groupBy("item_id").agg(F.max(F.round(F.col("duration") * 1000).cast("long")).alias("ms"))
    return h.select("request_id", F.explode("h").alias("item_id")).join(c, "item_id").groupBy("request_id").agg(F.sum("ms").alias("total_ms"), F.count(F.lit(1)).alias("n_known"))


@query("d17_tag_vectors", "WITH t AS (SELECT label AS tag, avg(embedding[1]) AS x FROM embeddings GROUP BY 1) SELECT vec_id, round(CASE WHEN label = 0 THEN 0 ELSE (x + coalesce(y, 0)) / (CASE WHEN y IS NULL THEN 1 ELSE 2 END) END, 5) AS x FROM embeddings JOIN t ON t.tag = label LEFT JOIN (SELECT tag, x AS y FROM t) o ON o.tag = label + 1")
def d17(spark, d):
    e = table(spark, d, "embeddings")
    tags = e.groupBy(F.col("label").alias("tag")).agg(F.array(F.avg(F.col("embedding")[0].cast("double"))).alias("vector"))
    items = e.select(F.col("vec_id").alias("item_id"), F.when(F.col("label") == 0, F.array(F.lit(0))).otherwise(F.array(F.col("label"), F.col("label") + 1)).alias("tags"))
    return encode.mean_tag_vector(items, tags, 1).select(F.col("item_id").alias("vec_id"), F.round(F.col("vector")[0], 5).alias("x"))


def _triples(spark, d):
    train, test = _parts(spark, d)
    return train.select("user_id", "item_id", "rating"), test.select("user_id", "item_id", "rating")


def _errors(model, test):
    return metrics.rating_errors(model.predict(test), "rating", "prediction")


@query("x07_als")
def x07(spark, d):
    train, test = _triples(spark, d)
    return _errors(factor.fit_als(train, k=6, iterations=3), test)


@query("x07_als_full")
def x07_full(spark, d):
    """Full size: 50 factors, 10 iterations."""
    train, test = _triples(spark, d)
    return _errors(factor.fit_als(train, k=50, iterations=10), test)


_HALF = """q AS (SELECT item_idx AS item_id, CAST(min(factors) AS DOUBLE[]) AS v FROM item_factors WHERE factors IS NOT NULL AND NOT list_bool_or(list_transform(factors, lambda x: isnan(x))) GROUP BY 1),
    s AS (SELECT user_id, sum(v[1] * v[1]) + 0.1 AS a, sum(v[1] * v[2]) AS b, sum(v[2] * v[2]) + 0.1 AS d, sum(v[1] * rating) AS x, sum(v[2] * rating) AS y FROM train JOIN q USING (item_id) GROUP BY 1)"""


@query("x07_als_half_step", with_(RATINGS, _T01, _HALF) + "SELECT user_id, round((d * x - b * y) / (a * d - b * b), 6) AS f1, round((a * y - b * x) / (a * d - b * b), 6) AS f2 FROM s")
def x07_half(spark, d):
    """One half step on two given factors, which has a closed form."""
    train, _ = _triples(spark, d)
    q = table(spark, d, "item_factors").where(F.col("factors").isNotNull() & ~F.exists("factors", F.isnan)).groupBy(F.col("item_idx").alias("idx")).agg(F.min("factors").alias("f"))
    q = q.select("idx", F.transform(F.slice("f", 1, 2), lambda x: x.cast("double")).alias("f"))
    half = factor.als_half_step(train.select("user_id", "item_id", F.col("rating").cast("double").alias("value")), "user_id", "item_id", q, 2, 0.1)
    return half.select(F.col("idx").alias("user_id"), F.round(F.col("f")[0], 6).alias("f1"), F.round(F.col("f")[1], 6).alias("f2"))


@query("x08_bias_aware_als")
def x08(spark, d):
    train, test = _triples(spark, d)
    return _errors(factor.fit_als(train, k=6, iterations=2, reg=5.0, biased=True), test)


@query("x09_nmf")
def x09(spark, d):
    train, test = _triples(spark, d)
    return _errors(factor.fit_nmf(train, k=6, iterations=5), test)


@query("x05_basic_mf")
def x05(spark, d):
    train, test = _triples(spark, d)
    return _errors(factor.fit_sgd(train, k=6, epochs=2), test)


@query("x06_biased_mf")
def x06(spark, d):
    train, test = _triples(spark, d)
    return _errors(factor.fit_sgd(train, k=6, epochs=2, biased=True), test)


@query("x10_svdpp")
def x10(spark, d):
    parts = split.explicit_boundary_split(ratings(spark, d, True), ["ts", "item_id"])
    model, _ = factor.fit_svdpp(parts.where("split = 'train'"), k=6, epochs=2)
    return _errors(model, parts.where("split = 'test'").select("user_id", "item_id", "rating"))


@query("k08_factor_recommend")
def k08(spark, d):
    train, _ = _triples(spark, d)
    model = factor.fit_als(train, k=6, iterations=2)
    return model.recommend_catalog(train).select("user_id", "item_id", "rank")


@query("x12_kmeans")
def x12(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _embeddings(spark, d)[1].select("idx", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=42, maxIter=10).fit(rows).transform(rows).select("idx", F.col("prediction").alias("cluster"))


@query("x13_pca")
def x13(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _embeddings(spark, d)[1].select("idx", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(rows).withColumn("xy", vector_to_array("xy"))
    return out.select("idx", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


@query("x14_tower_export")
def x14(spark, d):
    rng = np.random.default_rng(42)
    layers = [(rng.normal(size=(64, 32)) / 8, np.zeros(32)), (rng.normal(size=(32, 16)) / 6, np.zeros(16))]
    return towers.export_vectors(_embeddings(spark, d)[1], "idx", "v", layers)


@query(
    "x16_in_batch_loss",
    """WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, CAST(floor((row_number() OVER (ORDER BY md5('7|' || vec_id), vec_id) - 1) / 256) AS BIGINT) AS batch FROM embeddings),
    l AS (SELECT a.batch, a.vec_id, a.vec_id = b.vec_id AS own, list_dot_product(a.v, b.v) / CAST(0.1 AS DOUBLE) AS x FROM r a JOIN r b ON a.batch = b.batch AND (a.vec_id = b.vec_id OR a.label <> b.label)),
    m AS (SELECT batch, vec_id, max(x) AS top, max(x) FILTER (own) AS own FROM l GROUP BY ALL),
    s AS (SELECT l.batch, l.vec_id, ln(sum(exp(x - top))) + max(top) - max(m.own) AS loss FROM l JOIN m ON l.vec_id = m.vec_id GROUP BY ALL)
    SELECT batch, count(*) AS n, round(avg(loss), 5) AS loss FROM s GROUP BY batch""",
)
def x16(spark, d):
    rows = _embeddings(spark, d)[1].select("idx", F.col("v").alias("user_v"), F.col("v").alias("item_v"), F.col("label").cast("long").alias("item_id"))
    placed = global_index(rows, [seeded_order("idx", seed=7), F.col("idx")], "at").withColumn("batch", F.floor(F.col("at") / 256))
    return towers.in_batch_losses(placed, "batch", 0.1).withColumn("loss", F.round("loss", 5))

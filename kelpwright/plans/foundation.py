"""Queries of cleaning, de-duplication, encoding, splits and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpwright.functions import scalars as S
from kelpwright.operators import cleaning, dedup, encode, history, kcore, ranking, split
from kelpwright.plans.registry import Registry, table
from kelpwright.plans.views import ACTS, EVENTS, MIXED, RATINGS, acts, best_acts, events, ratings, raw_ratings, with_

registry = Registry()
query = registry.query


@query("s06_projection_scan", "SELECT item_id, tab, count(*) AS n FROM impressions GROUP BY ALL")
def s06(spark, d):
    return table(spark, d, "impressions").groupBy("item_id", "tab").agg(F.count(F.lit(1)).alias("n"))


@query("s07_predicate_scan", "SELECT request_id, user_id, item_id FROM impressions WHERE request_time_ms < 1714000000000 AND NOT is_random")
def s07(spark, d):
    return table(spark, d, "impressions").where((F.col("request_time_ms") < 1714000000000) & ~F.col("is_random")).select("request_id", "user_id", "item_id")


@query(
    "s24_permutation_batches",
    """SELECT row_id, CAST((row_number() OVER (ORDER BY md5('43|' || row_id), row_id) - 1) AS BIGINT) AS place,
       CAST(floor((row_number() OVER (ORDER BY md5('43|' || row_id), row_id) - 1) / 4096) AS BIGINT) AS batch FROM interactions""",
)
def s24(spark, d):
    ids = table(spark, d, "interactions").select("row_id")
    placed = ranking.global_index(ids, [ranking.seeded_order("row_id", seed=43), F.col("row_id")], "place")
    return placed.withColumn("batch", F.floor(F.col("place") / 4096))


@query("proj_p01_clean", with_(ACTS) + "SELECT row_id, user_id, item_id, rating, is_read, is_reviewed, CAST(epoch(date_trunc('second', event_time)) AS BIGINT) AS ts, CAST((rating > 0)::INT + is_read::INT + is_reviewed::INT AS INTEGER) AS information_score FROM acts")
def p01(spark, d):
    src = table(spark, d, "interactions")
    raw = src.select(
        "row_id", "user_id", F.lit(" ").alias("book_id"), "item_id", F.col("rating").cast("string").alias("rating"), F.col("is_read").cast("string").alias("is_read"),
        F.when(F.col("is_reviewed"), " YES ").otherwise("no").alias("is_reviewed"), F.lit("").alias("event_time"),
        F.concat(F.lit("Mon "), F.date_format("event_time", "MMM dd HH:mm:ss Z yyyy")).alias("date_updated"),
    )
    # The cleaned table has no row id of its own: clean per row beside it.
    rows = cleaning.clean_interactions(raw.withColumn("user_id", F.concat_ws("\u0001", "user_id", F.when(F.col("user_id").isNotNull(), F.col("row_id")))))
    parts = F.split("user_id", "\u0001")
    rows = rows.withColumns({"row_id": parts[1].cast("long"), "user_id": cleaning.present_id(parts[0])}).where("user_id IS NOT NULL")
    return rows.select("row_id", "user_id", "item_id", "rating", "is_read", "is_reviewed", F.unix_timestamp("event_time").alias("ts"), "information_score")


@query("proj_p02_normalize_events", "SELECT 'log:' || request_id AS request_id, user_id, item_id AS video_id, request_time_ms AS time_ms, CAST(long_view AS INT) AS long_view FROM impressions")
def p02(spark, d):
    t = table(spark, d, "impressions")
    return t.select(F.concat(F.lit("log:"), "request_id").alias("request_id"), "user_id", F.col("item_id").alias("video_id"), F.col("request_time_ms").alias("time_ms"), F.col("long_view").cast("int").alias("long_view"))


@query(
    "proj_p03_impute_median",
    "SELECT item_id, version_no, round(coalesce(CASE WHEN isfinite(duration) THEN duration END, (SELECT quantile_cont(duration, 0.5) FROM candidates WHERE isfinite(duration))), 6) AS duration FROM candidates",
)
def p03(spark, d):
    return cleaning.impute_median(table(spark, d, "candidates"), ["duration"]).select("item_id", "version_no", F.round("duration", 6).alias("duration"))


@query("proj_p04_first_of_list", "SELECT doc_id, coalesce(lang, '') AS first_lang FROM documents")
def p04(spark, d):
    printed = F.concat(F.lit("['"), F.coalesce("lang", F.lit("")), F.lit("', 'x']"))
    return table(spark, d, "documents").select("doc_id", S.first_of_list_text(F.when(F.col("lang").isNull(), F.lit("['']")).otherwise(printed)).alias("first_lang"))


@query("proj_p05_positives", "SELECT request_id, user_id, item_id FROM impressions WHERE long_view AND NOT is_random")
def p05(spark, d):
    return cleaning.positive_events(table(spark, d, "impressions")).select("request_id", "user_id", "item_id")


@query("proj_p06_implicit", with_(MIXED) + "SELECT user_id, item_id, rating > 0 AS is_explicit FROM ratings WHERE is_read OR is_reviewed OR rating > 0")
def p06(spark, d):
    return cleaning.implicit(ratings(spark, d, True)).select("user_id", "item_id", (F.col("rating") > 0).alias("is_explicit"))


_T02 = """numbered AS (SELECT *, coalesce(sum(CAST(rating > 0 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e,
      sum(CAST(rating > 0 AS INT)) OVER (PARTITION BY user_id) AS n FROM ratings),
    cut AS (SELECT *, least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 1), n - 2) AS a FROM numbered WHERE n >= 3),
    cut2 AS (SELECT *, least(greatest(floor(n * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))), a + 1), n - 1) AS b FROM cut),
    parts AS (SELECT user_id, item_id, rating, is_read, ts, CASE WHEN e < a THEN 'train' WHEN e < b THEN 'validation' ELSE 'test' END AS split FROM cut2),
    t02 AS (SELECT * FROM parts WHERE split = 'train' OR item_id IN (SELECT item_id FROM parts WHERE split = 'train'))"""


@query("t02_explicit_boundaries", with_(MIXED, _T02) + "SELECT user_id, item_id, rating, split FROM t02")
def t02(spark, d):
    return split.explicit_boundary_split(ratings(spark, d, True), ["ts", "item_id"]).select("user_id", "item_id", "rating", "split")


@query(
    "proj_p08_relevant_mixed",
    with_(MIXED, _T02)
    + """SELECT DISTINCT user_id, item_id FROM t02 t WHERE split = 'test' AND (rating >= 4 OR (rating = 0 AND is_read))
    AND item_id IN (SELECT item_id FROM t02 WHERE split = 'train') AND NOT EXISTS (SELECT 1 FROM t02 s WHERE s.split = 'train' AND s.user_id = t.user_id AND s.item_id = t.item_id)""",
)
def p08(spark, d):
    parts = split.explicit_boundary_split(ratings(spark, d, True), ["ts", "item_id"])
    train = parts.where("split = 'train'")
    return cleaning.relevant_mixed(parts.where("split = 'test'"), train, train)


@query("proj_p10_search", "SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang)), 'note en') ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 8")
def p10(spark, d):
    return cleaning.search(table(spark, d, "documents"), ["source", "lang"], "Note EN", 8, [F.desc_nulls_last("n_chars"), F.asc("doc_id")]).select("doc_id", "source")


@query("proj_p11_finite_features", "SELECT user_id, movie_id, ranking_score FROM recommendations WHERE isfinite(ranking_score) AND isfinite(rating_estimate)")
def p11(spark, d):
    ok = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return table(spark, d, "recommendations").where(ok("ranking_score") & ok("rating_estimate")).select("user_id", "movie_id", "ranking_score")


@query("d01_best_record", with_(ACTS) + "SELECT user_id, item_id, row_id, rating, information_score FROM best_acts")
def d01(spark, d):
    return best_acts(spark, d).select("user_id", "item_id", "row_id", "rating", "information_score")


@query(
    "d03_exact_repeats",
    "SELECT request_id, user_id, item_id, request_time_ms, min(tab) AS tab, count(*) AS copies FROM impressions GROUP BY request_id, user_id, item_id, request_time_ms HAVING count(*) > 1",
)
def d03(spark, d):
    t = table(spark, d, "impressions").select("request_id", "user_id", "item_id", "request_time_ms", "tab")
    return dedup.drop_exact_repeats(t, "tab", ["request_id", "user_id", "item_id", "request_time_ms"]).where("copies > 1")


@query("d04_key_first", "SELECT item_id, version_no FROM candidates WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY version_no) = 1")
def d04(spark, d):
    return dedup.best_record(table(spark, d, "candidates").where("item_id IS NOT NULL").select("item_id", "version_no"), ["item_id"], [F.asc("version_no")])


_CORE_ROUNDS = 12


def _core_sql() -> str:
    parts, last = [ACTS, "k0 AS (SELECT user_id, item_id, rating FROM best_acts)"], "k0"
    for r in range(_CORE_ROUNDS):
        for key, least, rated in (("user_id", 5, 2), ("item_id", 5, 2)):
            new = f"k{r + 1}{key[0]}"
            parts.append(f"{new} AS MATERIALIZED (SELECT * FROM {last} WHERE {key} IN (SELECT {key} FROM {last} GROUP BY {key} HAVING count(*) >= {least} AND count(*) FILTER (rating > 0) >= {rated}))")
            last = new
    return with_(*parts) + f"SELECT user_id, item_id, rating FROM {last}"


@query("d05_k_core", _core_sql())
def d05(spark, d):
    return kcore.iterative_k_core(best_acts(spark, d).select("user_id", "item_id", "rating"), 5, 2, 5, 2)


@query("d06_sample_users", with_(ACTS) + "SELECT user_id, count(*) AS n FROM acts WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM acts) ORDER BY md5('42|' || user_id), user_id LIMIT 250) GROUP BY user_id")
def d06(spark, d):
    return encode.sample_users(acts(spark, d), 250).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("d07_encode_ids", with_(ACTS) + "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM acts)")
def d07(spark, d):
    return encode.encode_ids(acts(spark, d), "item_id", "item_idx")


@query(
    "d08_stratified",
    """WITH k AS (SELECT doc_id, coalesce(source, '') AS source, n_chars, md5('42|' || doc_id) AS h FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r, (SELECT greatest(1, floor(500 / count(DISTINCT source))) FROM k) AS each FROM k)
    SELECT doc_id, source FROM r ORDER BY CAST(r > each AS INT), h, doc_id LIMIT 500""",
)
def d08(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    return encode.stratified_sample(docs, 500, ["source"], "doc_id", [F.asc("doc_id")]).select("doc_id", "source")


@query("d09_sample_rows", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 40")
def d09(spark, d):
    return encode.sample_rows(table(spark, d, "documents").select("doc_id"), 40, "doc_id")


@query(
    "d10_vocabulary",
    """WITH fit AS (SELECT DISTINCT coalesce(CAST(category AS VARCHAR), '__missing__') AS v FROM candidates WHERE version_no = 1),
    codes AS (SELECT v, row_number() OVER (ORDER BY v) AS code FROM fit)
    SELECT c.item_id, c.version_no, coalesce(code, 0) AS code FROM candidates c LEFT JOIN codes ON codes.v = coalesce(CAST(c.category AS VARCHAR), '__missing__')""",
)
def d10(spark, d):
    t = table(spark, d, "candidates")
    return encode.apply_vocabulary(t, "category", encode.fit_vocabulary(t.where("version_no = 1"), "category"), "code").select("item_id", "version_no", "code")


@query(
    "d12_standardize",
    """WITH m AS (SELECT quantile_cont(duration, 0.5) AS m FROM candidates WHERE version_no = 1), f AS (SELECT coalesce(duration, m) AS x FROM candidates, m WHERE version_no = 1),
    s AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM f) SELECT item_id, version_no, round((coalesce(duration, m) - a) / s, 6) AS duration FROM candidates, m, s""",
)
def d12(spark, d):
    t = table(spark, d, "candidates").select("item_id", "version_no", "duration")
    return encode.standardize(t, ["duration"], t.where("version_no = 1")).withColumn("duration", F.round("duration", 6))


@query("d13_day_offset", "SELECT doc_id, date_diff('day', (SELECT min(CAST(written_at AS DATE)) FROM documents WHERE source = 'review'), CAST(written_at AS DATE)) AS days FROM documents")
def d13(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", F.to_date("written_at").alias("day"))
    return encode.day_offset(t, "day", t.where("source = 'review'"), "days").select("doc_id", F.col("days").cast("long").alias("days"))


@query("d14_min_max", "SELECT row_id, round((rating - (SELECT min(rating) FROM interactions)) / CAST((SELECT max(rating) - min(rating) FROM interactions) AS DOUBLE), 6) AS rating FROM interactions")
def d14(spark, d):
    return encode.min_max(table(spark, d, "interactions").select("row_id", "rating"), ["rating"]).select("row_id", F.round("rating", 6).alias("rating"))


@query("d15_z_score", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 5) AS z FROM orders")
def d15(spark, d):
    return encode.z_score(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 5).alias("z"))


@query("d16_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))), 5) AS total FROM embeddings")
def d16(spark, d):
    unit = S.l2_normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(
    "d18_cyclic_time",
    """SELECT request_id, round(sin(2 * pi() * ((time_ms // 1000) % 86400) / 86400), 6) AS day_sin, round(cos(2 * pi() * ((time_ms // 1000 + 259200) % 604800) / 604800), 6) AS week_cos
    FROM (SELECT DISTINCT request_id, time_ms FROM validation)""",
)
def d18(spark, d):
    c = S.cyclic(F.col("time_ms"))
    return table(spark, d, "validation").select("request_id", "time_ms").distinct().select("request_id", F.round(c["day_sin"], 6).alias("day_sin"), F.round(c["week_cos"], 6).alias("week_cos"))


@query("d19_log_age", "SELECT item_id, version_no, round(ln(1 + greatest(0, first_observed_ms - 1674000000000) / 3600000.0::DOUBLE), 6) AS log_age FROM candidates")
def d19(spark, d):
    age = F.greatest(F.lit(0), F.col("first_observed_ms") - 1674000000000) / F.lit(3600000.0)
    return table(spark, d, "candidates").select("item_id", "version_no", F.round(F.log1p(F.when(F.col("first_observed_ms").isNull(), F.lit(0.0)).otherwise(age)), 6).alias("log_age"))


@query(
    "d20_pad_histories",
    """WITH h AS (SELECT DISTINCT request_id, list_filter(coalesce(history_item_ids, []), lambda x: x IS NOT NULL) AS h FROM validation)
    SELECT request_id, list_concat(list_resize(CAST([] AS BIGINT[]), greatest(0, 10 - len(h)), -1), h[greatest(1, len(h) - 9):]) AS padded, least(10, len(h)) AS n_real FROM h""",
)
def d20(spark, d):
    h = F.filter(F.coalesce("history_item_ids", F.array().cast("array<bigint>")), lambda x: x.isNotNull())
    rows = table(spark, d, "validation").select("request_id", h.alias("h")).distinct()
    real = F.size(F.filter(S.pad_mask(F.col("h"), 10), lambda x: x)).cast("long")
    return rows.select("request_id", S.right_aligned(F.col("h"), 10).alias("padded"), real.alias("n_real"))


@query("d21_first_tag", "SELECT item_id, version_no, CAST(coalesce(category, -1) AS BIGINT) AS category, round(coalesce(duration / 1000, 0), 6) AS seconds FROM candidates")
def d21(spark, d):
    tags = F.concat(F.col("category").cast("string"), F.lit(",12"))
    return table(spark, d, "candidates").select("item_id", "version_no", S.first_tag(tags).alias("category"), F.round(F.coalesce(F.col("duration") / 1000, F.lit(0.0)), 6).alias("seconds"))


@query("d22_triplets", with_(MIXED) + "SELECT user_id, item_id, CAST(sum(rating) AS BIGINT) AS rating FROM raw_ratings WHERE rating > 0 GROUP BY ALL")
def d22(spark, d):
    return encode.explicit_triplets(raw_ratings(spark, d, True))


@query(
    "d23_gather_features",
    """SELECT i.item_id, CASE WHEN i.item_id = -1 THEN 0 ELSE c.category END AS category FROM (SELECT DISTINCT item_id FROM validation WHERE item_id IS NOT NULL UNION ALL SELECT -1) i
    LEFT JOIN (SELECT item_id, max(category) AS category FROM candidates GROUP BY item_id) c USING (item_id)""",
)
def d23(spark, d):
    ids = table(spark, d, "validation").select("item_id").where("item_id IS NOT NULL").distinct().unionByName(spark.createDataFrame([(-1,)], "item_id long"))
    features = table(spark, d, "candidates").groupBy("item_id").agg(F.max("category").alias("category"))
    return encode.gather_features(ids, features, "item_id", ["category"])


@query(
    "t01_per_user_split",
    with_(RATINGS)
    + """, n AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ratings),
    c AS (SELECT *, least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 1), n - 2) AS a FROM n WHERE n >= 3)
    SELECT user_id, item_id, CASE WHEN k < a THEN 'train' WHEN k < least(greatest(floor(n * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))), a + 1), n - 1) THEN 'validation' ELSE 'test' END AS split FROM c""",
)
def t01(spark, d):
    return split.per_user_split(ratings(spark, d), ["ts", "item_id"]).select("user_id", "item_id", "split")


_CUTS = [("warmup", 1712000000000), ("train", 1718000000000), ("validation", 1721000000000)]


@query(
    "t03_time_windows",
    """SELECT CASE WHEN is_random THEN 'random' WHEN request_time_ms IS NULL THEN NULL WHEN request_time_ms < 1712000000000 THEN 'warmup' WHEN request_time_ms < 1718000000000 THEN 'train'
    WHEN request_time_ms < 1721000000000 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(request_time_ms) AS first_ms, max(request_time_ms) AS last_ms FROM impressions GROUP BY 1""",
)
def t03(spark, d):
    parts = split.time_window_split(table(spark, d, "impressions").drop("split"), _CUTS, "test", "request_time_ms", "is_random")
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("request_time_ms").alias("first_ms"), F.max("request_time_ms").alias("last_ms"))


@query(
    "t05_reencode_splits",
    with_(MIXED, _T02) + "SELECT split, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM t02 JOIN (SELECT item_id, row_number() OVER (ORDER BY CAST(item_id AS VARCHAR)) - 1 AS idx FROM (SELECT DISTINCT item_id FROM t02)) USING (item_id) GROUP BY split",
)
def t05(spark, d):
    parts = split.explicit_boundary_split(ratings(spark, d, True), ["ts", "item_id"])
    return parts.join(encode.encode_ids(parts, "item_id", "idx"), "item_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query("t06_refit_union", with_(MIXED, _T02) + "SELECT user_id, count(*) AS n FROM t02 WHERE split IN ('train', 'validation') GROUP BY user_id")
def t06(spark, d):
    parts = split.explicit_boundary_split(ratings(spark, d, True), ["ts", "item_id"])
    return parts.where("split = 'train'").unionByName(parts.where("split = 'validation'")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_POS = "pos AS (SELECT * FROM ev WHERE long_view AND NOT is_random)"


@query(
    "h01_prior_history",
    with_(EVENTS, _POS)
    + """SELECT p.request_id, coalesce(h.h[greatest(1, len(h.h) - 49):], CAST([] AS BIGINT[])) AS history_item_ids FROM pos p LEFT JOIN (
      SELECT a.request_id, list(b.item_id ORDER BY b.request_time_ms, b.request_id) AS h FROM pos a JOIN pos b ON a.user_id = b.user_id AND b.request_time_ms < a.request_time_ms GROUP BY a.request_id) h USING (request_id)""",
)
def h01(spark, d):
    return history.prior_histories(cleaning.positive_events(events(spark, d)))


def _completed(spark, d):
    play = F.pmod(F.col("item_id"), F.lit(600)) * 1000
    pos = cleaning.positive_events(events(spark, d)).select("user_id", "item_id", "request_id", F.col("request_time_ms").alias("time_ms"), (F.col("request_time_ms") + play).alias("available_ms"))
    from pyspark.sql import Window

    return pos.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("time_ms", "request_id")).cast("long"))


_DONE = "done AS (SELECT user_id, item_id, request_id, request_time_ms AS t, request_time_ms + (item_id % 600) * 1000 AS available, row_number() OVER (PARTITION BY user_id ORDER BY request_time_ms, request_id) AS ordinal FROM pos)"
_DONE_H = """dh AS (SELECT a.user_id, a.ordinal, a.request_id, a.t, coalesce(list(b.item_id ORDER BY b.ordinal) FILTER (b.item_id IS NOT NULL), CAST([] AS BIGINT[])) AS h FROM done a
      LEFT JOIN done b ON a.user_id = b.user_id AND b.available < a.t GROUP BY ALL)"""


@query("h02_completed_history", with_(EVENTS, _POS, _DONE, _DONE_H) + "SELECT user_id, ordinal, h[greatest(1, len(h) - 49):] AS history_item_ids FROM dh")
def h02(spark, d):
    return history.completed_histories(_completed(spark, d))


@query(
    "h03_history_drift",
    with_(EVENTS, _POS, _DONE, _DONE_H)
    + """, ph AS (SELECT a.request_id, coalesce(list(b.item_id ORDER BY b.ordinal) FILTER (b.item_id IS NOT NULL), CAST([] AS BIGINT[])) AS h FROM done a LEFT JOIN done b ON a.user_id = b.user_id AND b.t < a.t GROUP BY ALL)
    SELECT count(*) AS compared, count(*) FILTER (dh.h[greatest(1, len(dh.h) - 49):] IS DISTINCT FROM ph.h[greatest(1, len(ph.h) - 49):]) AS drifted FROM dh JOIN ph USING (request_id)""",
)
def h03(spark, d):
    done = _completed(spark, d)
    prior = history.prior_histories(done, time="time_ms")
    completed = history.completed_histories(done).join(done.select("user_id", "ordinal", "request_id"), ["user_id", "ordinal"])
    return history.history_drift(prior, completed.select("request_id", "history_item_ids"), ["request_id"])


@query("h05_implicit_items", with_(MIXED) + "SELECT user_id, list_sort(list(DISTINCT item_id)) AS items FROM ratings WHERE is_read OR is_reviewed OR rating > 0 GROUP BY user_id")
def h05(spark, d):
    return history.implicit_items(cleaning.implicit(ratings(spark, d, True)))


@query("h07_first_observed", "SELECT item_id, min(request_time_ms) AS eligible_after_ms FROM impressions WHERE item_id IS NOT NULL GROUP BY item_id")
def h07(spark, d):
    return history.first_observed(table(spark, d, "impressions"))


@query("h07_eligible_after", "SELECT doc_id, (date_diff('day', DATE '1970-01-01', CAST(written_at AS DATE)) + 1) * 86400000 AS eligible_after_ms FROM documents")
def h07b(spark, d):
    return table(spark, d, "documents").select("doc_id", S.eligible_after(F.to_date("written_at")).alias("eligible_after_ms"))

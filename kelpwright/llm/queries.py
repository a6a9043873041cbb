"""Queries of the training-data problems tagged llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwright.llm.bpe import count_tokens, encode_corpus
from kelpwright.llm.consensus import best_representatives, tagged, words
from kelpwright.llm.cooccurrence import cooccurring_pairs
from kelpwright.llm.mixing import mix_sources, reached_shares
from kelpwright.llm.similar import most_similar, usable_vectors
from kelpwright.llm.spans import shared_spans
from kelpwright.llm.topn import top_n_per_group
from kelpwright.operators.text_ids import present_id
from kelpwright.operators.vectors import exact_top_k
from kelpwright.plans.registry import Registry, table
from kelpwright.storage import Workspace

registry = Registry()


@registry.query(
    "p1_found",
    """
    WITH firsts AS (
      SELECT * FROM recommendations WHERE user_id IS NOT NULL AND isfinite(ranking_score)
      QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY ranking_score DESC, secondary_score DESC NULLS LAST, similarity_weight_sum DESC NULLS LAST) = 1)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ranking_score DESC, secondary_score DESC NULLS LAST,
             similarity_weight_sum DESC NULLS LAST, movie_id) AS INTEGER) AS pos, movie_id
    FROM firsts QUALIFY pos <= 10
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    recommendations = table(spark, sf_dir, "recommendations")
    return top_n_per_group(recommendations, "user_id", "ranking_score", "movie_id", ("secondary_score", "similarity_weight_sum"))


@registry.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for kind in ("item", "user"):
        near = most_similar(table(spark, sf_dir, f"{kind}_factors"), f"{kind}_idx", "factors", min_cosine=0.9)
        found.append(near.select(F.lit(kind).alias("kind"), F.col("idx").cast("int").alias("idx"), F.col("neighbor_idx").cast("int").alias("neighbor_idx")))
    return found[0].unionByName(found[1])


def _hundredths(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and as queries those whose id is divisible by 100."""
    rows = table(spark, sf_dir, f"{kind}_factors").withColumnRenamed(f"{kind}_idx", "idx")
    return rows, rows.where("idx % 100 = 0").select("idx")


@registry.query("p2_top10")
def p2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for kind in ("item", "user"):
        rows, asked = _hundredths(spark, sf_dir, kind)
        found.append(most_similar(rows, "idx", "factors", queries=asked).select(F.lit(kind).alias("kind"), "idx", "neighbor_idx", "cosine"))
    return found[0].unionByName(found[1])


@registry.query("p2_recall")
def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: how many of the exact 10 best most_similar finds, without a floor."""
    reached = []
    for kind in ("item", "user"):
        rows, asked = _hundredths(spark, sf_dir, kind)
        found = most_similar(rows, "idx", "factors", queries=asked)
        usable, _ = usable_vectors(rows, "idx", "factors")
        usable = Workspace(spark, "recall").write(usable, "usable")
        exact = exact_top_k(usable.where("idx % 100 = 0"), usable, 10).select(F.col("query").alias("idx"), F.col("neighbor").alias("neighbor_idx"))
        hit = exact.join(found.select("idx", "neighbor_idx", F.lit(1).alias("hit")), ["idx", "neighbor_idx"], "left")
        reached.append(hit.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")))
    return reached[0].unionByName(reached[1])


def _rated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    rows = table(spark, sf_dir, "interactions").where("event_time IS NOT NULL AND rating BETWEEN 0 AND 5")
    rows = rows.withColumns({"user_id": present_id("user_id"), "item_id": present_id("item_id")})
    return rows, [F.col("information_score"), F.col("event_time"), -F.col("row_id")]


@registry.query(
    "p4_found",
    """
    WITH r AS (
      SELECT row_id, trim(user_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) AS user_id, trim(item_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) AS item_id,
             rating, row_number() OVER (PARTITION BY trim(user_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)), trim(item_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))
                                        ORDER BY information_score DESC NULLS LAST, event_time DESC, row_id) AS k
      FROM interactions WHERE event_time IS NOT NULL AND rating BETWEEN 0 AND 5)
    SELECT user_id, item_id, min(row_id) FILTER (k = 1) AS row_id, coalesce(arg_min(row_id, k) FILTER (rating > 0), min(row_id) FILTER (k = 1)) AS rating_row_id
    FROM r WHERE user_id <> '' AND item_id <> '' GROUP BY user_id, item_id HAVING count(*) > 1
    """,
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, trust = _rated(spark, sf_dir)
    rating = {"rating_row_id": (words("rating"), F.col("rating") > 0)}
    return best_representatives(rows, ["user_id", "item_id"], "row_id", trust, words("rating", "is_read", "is_reviewed"), rating)


@registry.query(
    "p4_consensus",
    """
    WITH r AS (
      SELECT row_id, trim(user_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) AS user_id, trim(item_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) AS item_id,
             information_score AS s, event_time AS t, rating, coalesce(CAST(is_read AS VARCHAR), '') AS is_read, coalesce(CAST(is_reviewed AS VARCHAR), '') AS is_reviewed
      FROM interactions WHERE event_time IS NOT NULL AND rating BETWEEN 0 AND 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY s DESC NULLS LAST, t DESC, row_id) AS k, count(*) OVER (PARTITION BY user_id, item_id) AS n
          FROM r WHERE user_id <> '' AND item_id <> ''),
    long AS (UNPIVOT (SELECT user_id, item_id, k, CAST(rating AS VARCHAR) AS rating, is_read, is_reviewed FROM k WHERE n > 1) ON rating, is_read, is_reviewed INTO NAME field VALUE token),
    votes AS (SELECT user_id, item_id, field, token, count(*) AS w, min(k) AS k FROM long GROUP BY ALL),
    elected AS (SELECT user_id, item_id, field, token FROM votes QUALIFY row_number() OVER (PARTITION BY user_id, item_id, field ORDER BY w DESC, k) = 1),
    far AS (SELECT l.user_id, l.item_id, l.k, count(*) FILTER (l.token <> e.token) AS d FROM long l JOIN elected e USING (user_id, item_id, field) GROUP BY ALL),
    best AS (SELECT user_id, item_id, k FROM far QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY d, k) = 1)
    SELECT user_id, item_id, row_id FROM k JOIN best USING (user_id, item_id, k)
    """,
)
def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row closest to what most rows of its group say, field by field."""
    rows, trust = _rated(spark, sf_dir)
    return best_representatives(rows, ["user_id", "item_id"], "row_id", trust, tagged("rating", "is_read", "is_reviewed"), vote="count")


@registry.query(
    "p7_found",
    """
    WITH r AS (SELECT DISTINCT request_id, i AS item FROM (SELECT request_id, unnest(history_item_ids) AS i FROM validation) WHERE i IS NOT NULL),
    n AS (SELECT count(DISTINCT request_id) AS n FROM r),
    c AS (SELECT item, count(*) AS n FROM r GROUP BY item),
    ab AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM r x JOIN r y ON x.request_id = y.request_id AND x.item < y.item
           GROUP BY ALL HAVING count(*) >= 20)
    SELECT item_a, item_b FROM ab JOIN c a ON a.item = item_a JOIN c b ON b.item = item_b, n
    WHERE n_ab * n.n >= 8 * a.n * b.n
    """,
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurring_pairs(table(spark, sf_dir, "validation"), "request_id", "history_item_ids", min_count=20)
    return pairs.where("n_ab * n >= 8 * n_a * n_b").select("item_a", "item_b")


@registry.query(
    "p7_counts",
    """
    WITH r AS (SELECT DISTINCT request_id, i AS item FROM (SELECT request_id, unnest(history_item_ids) AS i FROM validation) WHERE i IS NOT NULL),
    n AS (SELECT count(DISTINCT request_id) AS n FROM r),
    c AS (SELECT item, count(*) AS n FROM r GROUP BY item),
    ab AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM r x JOIN r y ON x.request_id = y.request_id AND x.item < y.item GROUP BY ALL)
    SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, n.n AS n, n_ab * CAST(n.n AS DOUBLE) / (a.n * b.n) AS lift
    FROM ab JOIN c a ON a.item = item_a JOIN c b ON b.item = item_b, n
    """,
)
def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and lift of p7_surprise, for comparison with SQL."""
    return p7_surprise(spark, sf_dir).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift")


@registry.query("p7_surprise")
def p7_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring_pairs(table(spark, sf_dir, "validation"), "request_id", "history_item_ids")


@registry.query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language: the code before a suffix, lower case; topic: the item's category."""
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.lower(F.substring_index("lang", "-", 1)))
    sized = count_tokens(docs, keep=("doc_id", "source", "lang", "item_id"))
    versions = table(spark, sf_dir, "candidates").where("item_id IS NOT NULL AND category >= 0")
    topics = versions.groupBy("item_id").agg(F.max(F.struct("version_no", "category")).alias("v")).select("item_id", F.col("v.category").alias("topic"))
    sized = Workspace(spark, "mix").write(sized.join(topics, "item_id", "left").drop("item_id"), "sized")
    return mix_sources(sized, table(spark, sf_dir, "source_targets"))


@registry.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)


@registry.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(_mix(spark, sf_dir), table(spark, sf_dir, "source_targets"))


@registry.query(
    "p10_found",
    """
    WITH g AS (
      SELECT doc_id, p, substr(text, p, 150) AS s
      FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS p FROM documents WHERE length(text) >= 150)),
    several AS (SELECT s FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT DISTINCT doc_id, p FROM g JOIN several USING (s))
    SELECT doc_id, CAST(sum(least(150, nxt - p)) AS BIGINT) AS shared_chars
    FROM (SELECT doc_id, p, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p), p + 150) AS nxt FROM hit) GROUP BY doc_id
    """,
)
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))

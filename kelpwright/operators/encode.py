"""Id and feature encoding, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpwright.operators.ranking import equal_count_bucket, global_index, seeded_order


def encode_ids(df: DataFrame, column: str, output: str) -> DataFrame:
    """(column, output): 0..n-1 over the distinct ids in order of their text."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    return global_index(ids, [F.col(column).cast("string")], output)


def sample_users(df: DataFrame, n: int, user: str = "user_id", seed: int = 42) -> DataFrame:
    """All rows of n users drawn by a seeded hash order."""
    users = df.select(user).where(F.col(user).isNotNull()).distinct()
    return df.join(users.orderBy(seeded_order(user, seed=seed), user).limit(n), user, "left_semi")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, by a seeded hash order of a unique key."""
    return df.orderBy(seeded_order(key, seed=seed), key).limit(n)


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str], key: str, order: Sequence[Column], seed: int = 42) -> DataFrame:
    """n rows: an equal number of each stratum, topped up from the rest."""
    groups = max(1, df.select(*strata).distinct().count())
    each = max(1, n // groups)
    ranked = df.withColumn("__h", seeded_order(key, seed=seed))
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key)))
    # Chosen rows first, then the others, each in hash order: the first n of it.
    first = ranked.orderBy((F.col("__r") > each).cast("int"), "__h", key).limit(n)
    return first.drop("__h", "__r").orderBy(*order)


def popularity_bands(df: DataFrame, value: str, key: str, k: int, output: str = "band") -> DataFrame:
    """Quantile bands of ``value`` (ties by key) over the whole table, 1..k."""
    indexed = global_index(df, [F.col(value), F.col(key)], "__place")
    n = indexed.agg(F.count(F.lit(1)).alias("__n"))
    return indexed.crossJoin(F.broadcast(n)).withColumn(output, equal_count_bucket(F.col("__place") + 1, F.col("__n"), k)).drop("__place", "__n")


MISSING = "__missing__"


def fit_vocabulary(fit: DataFrame, column: str) -> DataFrame:
    """(value, code): the fitted values in order of their text from 1; 0 is unknown."""
    values = fit.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).distinct()
    return global_index(values, [F.col("value")], "code").withColumn("code", F.col("code") + 1)


def apply_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, output: str) -> DataFrame:
    coded = vocabulary.withColumnsRenamed({"value": "__value", "code": output})
    own = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return df.join(coded, own == F.col("__value"), "left").drop("__value").withColumn(output, F.coalesce(output, F.lit(0)))


def standardize(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Nulls as the fit rows' median, then (x - mean) / population std.

    A constant column divides by 1.  Mean and std are those of the imputed fit rows.
    """
    fit = df if fit is None else fit
    middle = fit.agg(*(F.percentile(F.col(c), F.lit(0.5)).alias(f"__m_{c}") for c in columns))
    filled = fit.crossJoin(F.broadcast(middle)).select(*(F.coalesce(c, f"__m_{c}").alias(c) for c in columns))
    scale = filled.agg(*(x for c in columns for x in (F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))))
    stats = middle.crossJoin(F.broadcast(scale))
    out = {c: (F.coalesce(F.col(c), F.col(f"__m_{c}")) - F.col(f"__a_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(out).drop(*(f"__{k}_{c}" for c in columns for k in "mas"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    stats = df.agg(*(x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))))
    out = {}
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        out[c] = F.when(F.col(c).isNotNull(), F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / F.when(span > 0, span), F.lit(0.0)))
    return df.crossJoin(F.broadcast(stats)).withColumns(out).drop(*(f"__{k}_{c}" for c in columns for k in ("lo", "hi")))


def z_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    return standardize(df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)), columns)


def day_offset(df: DataFrame, column: str, fit: DataFrame, output: str) -> DataFrame:
    """Days since the first date of the fit rows."""
    first = fit.agg(F.min(column).alias("__first"))
    return df.crossJoin(F.broadcast(first)).withColumn(output, F.datediff(column, "__first")).drop("__first")


def mean_tag_vector(items: DataFrame, tags: DataFrame, dim: int, item: str = "item_id", tag_list: str = "tags") -> DataFrame:
    """(item, vector): mean vector of an item's non-zero tags; zeros if none.

    ``tags``: tag, vector.  Unknown tags do not count.
    """
    long = items.select(item, F.explode(tag_list).alias("tag")).where("tag != 0").join(tags, "tag")
    parts = long.groupBy(item).agg(*(F.avg(F.col("vector")[k]).alias(f"__{k}") for k in range(dim)))
    vector = F.array(*(F.coalesce(f"__{k}", F.lit(0.0)) for k in range(dim)))
    return items.select(item).distinct().join(parts, item, "left").select(item, vector.alias("vector"))


def explicit_triplets(df: DataFrame, user: str = "user_id", item: str = "item_id", value: str = "rating") -> DataFrame:
    """(user, item, value): positive ratings, duplicates summed."""
    return df.where(F.col(value) > 0).groupBy(user, item).agg(F.sum(value).alias(value))


def gather_features(ids: DataFrame, features: DataFrame, item: str, columns: Sequence[str]) -> DataFrame:
    """Feature rows of item ids; the padding id -1 gets zeros."""
    joined = ids.join(features.select(item, *columns), item, "left")
    return joined.withColumns({c: F.when(F.col(item) == -1, F.lit(0)).otherwise(F.col(c)) for c in columns})


def log_frequency(counts: DataFrame, count: str, smoothing: float = 1.0, output: str = "log_q") -> DataFrame:
    """log of the smoothed sampling probability of each item."""
    total = counts.agg(F.sum(count).alias("__n"), F.count(F.lit(1)).alias("__d"))
    q = (F.col(count) + smoothing) / (F.col("__n") + smoothing * F.col("__d"))
    return counts.crossJoin(F.broadcast(total)).withColumn(output, F.log(q)).drop("__n", "__d")


def labels(mapping: Mapping[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in mapping.items()]

"""Record cleaning and the filters on explicit and implicit feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwright.functions.scalars import flexible_timestamp, truthy
from kelpwright.operators.text_ids import present_id

TIME_FIELDS = ("event_time", "date_updated", "read_at", "date_added")


def information_score(rating: str = "rating", is_read: str = "is_read", is_reviewed: str = "is_reviewed") -> Column:
    """How much a record says: rated, read and reviewed count one each."""
    parts = (F.col(rating) > 0, F.col(is_read), F.col(is_reviewed))
    return sum((F.coalesce(p.cast("int"), F.lit(0)) for p in parts), F.lit(0))


def clean_interactions(raw: DataFrame) -> DataFrame:
    """Typed interactions from text records.

    Ids are trimmed and must not be blank (book_id, else item_id); rating must
    be a whole number 0..5; the first non-empty time field must parse; flags are
    true for 1, true, yes and the like.  Absent columns count as null.
    """
    have = set(raw.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    time = F.coalesce(*(F.when(F.trim(col(c)) != "", F.trim(col(c))) for c in TIME_FIELDS))
    rows = raw.select(
        present_id(col("user_id")).alias("user_id"),
        F.coalesce(present_id(col("book_id")), present_id(col("item_id"))).alias("item_id"),
        F.trim(col("rating")).try_cast("int").alias("rating"),
        truthy(col("is_read")).alias("is_read"),
        truthy(col("is_reviewed")).alias("is_reviewed"),
        flexible_timestamp(time).alias("event_time"),
    )
    rows = rows.where("user_id IS NOT NULL AND item_id IS NOT NULL AND rating BETWEEN 0 AND 5 AND event_time IS NOT NULL")
    return rows.withColumn("information_score", information_score().cast("int"))


def positive_events(events: DataFrame) -> DataFrame:
    """Long views that were not shown at random; null flags are not positive."""
    return events.where(F.col("long_view") & ~F.col("is_random"))


def explicit(df: DataFrame) -> DataFrame:
    return df.where("rating > 0")


def implicit(df: DataFrame) -> DataFrame:
    return df.where("coalesce(is_read, false) OR coalesce(is_reviewed, false) OR coalesce(rating, 0) > 0")


def relevant_mixed(test: DataFrame, catalog: DataFrame, seen: DataFrame, threshold: int = 4) -> DataFrame:
    """Relevant (user, item): rated well, or read without a rating; in the
    catalog and unseen.  Users left without any drop out."""
    hit = test.where((F.col("rating") >= threshold) | ((F.col("rating") == 0) & F.col("is_read")))
    pairs = hit.select("user_id", "item_id").distinct()
    return pairs.join(catalog.select("item_id").distinct(), "item_id", "left_semi").join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select("user_id", "item_id")


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers with text, NaN and infinities as null, nulls as the exact median."""
    number = {c: F.col(c).try_cast("double") for c in columns}
    finite = df.withColumns({c: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for c, v in number.items()})
    middle = finite.agg(*(F.percentile(F.col(c), F.lit(0.5)).alias(f"__{c}") for c in columns))
    return finite.crossJoin(F.broadcast(middle)).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def search(df: DataFrame, fields: Sequence[str], needle: str, n: int = 8, order: Sequence[Column] = ()) -> DataFrame:
    """The first n rows whose fields, joined by a space, contain the needle."""
    text = F.lower(F.concat_ws(" ", *fields))
    return df.where(text.contains(needle.lower())).orderBy(*order).limit(n)

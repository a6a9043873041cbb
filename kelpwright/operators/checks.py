"""Validation operators: each returns its findings, `require` raises on them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwright.functions.scalars import day_text


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by several rows, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass; null is no break."""
    counts = df.agg(*(F.count_if(bad).alias(name) for name, bad in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("v")).select("v.*")


def require(findings: DataFrame, what: str) -> None:
    """Raise if any finding has a count above zero."""
    bad = findings.where("n > 0").limit(10).collect()
    if bad:
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")


def uncovered(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of ``df`` whose non-null key the reference lacks."""
    return df.where(F.col(key).isNotNull()).join(reference.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides hold."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def split_windows(df: DataFrame, split: str, time: str) -> DataFrame:
    """(split, first, last, overlaps): whether a split starts before another one's
    start but ends at or after it.  Splits are few; their extents are compared."""
    spans = df.where(F.col(split).isNotNull() & F.col(time).isNotNull()).groupBy(split).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    other = spans.select(F.col(split).alias("o"), F.col("first").alias("f"))
    late = (F.col("o") != F.col(split)) & (F.col("f") >= F.col("first")) & (F.col("f") <= F.col("last"))
    hit = spans.join(F.broadcast(other), late, "left").groupBy(split).agg(F.count("o").alias("overlaps"))
    return spans.join(hit, split)


def snapshot_differences(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: keys only in the old, only in the new, and mismatches by column."""
    a = old.select(*keys, F.struct(*columns).alias("a"))
    b = new.select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, list(keys), "full")
    have = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("only_old"), F.count_if(F.col("a").isNull()).alias("only_new"),
        *(F.count_if(have & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns),
    )


def calendar_mismatches(df: DataFrame, ms: str, day: str, offsets: Sequence[int] = (0, 8)) -> DataFrame:
    """One row: rows whose stated yyyymmdd is not that of the instant, by offset."""
    return df.agg(*(F.count_if(day_text(F.col(ms), h) != F.col(day).cast("string")).alias(f"utc{h}") for h in offsets))


def history_mismatches(published: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """One row: published histories checked, absent from the other, different."""
    both = published.select(key, F.col("history_item_ids").alias("p"), F.lit(True).alias("has")).join(recomputed.select(key, F.col("history_item_ids").alias("r")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("r").isNull()).alias("absent"), F.count_if(F.col("r").isNotNull() & ~F.col("p").eqNullSafe(F.col("r"))).alias("different"))


def far_apart(pairs: DataFrame, a: str, b: str, tolerance: float = 1e-5) -> DataFrame:
    """One row: pairs compared and those further apart than the tolerance."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.abs(F.col(a) - F.col(b)) > tolerance).alias("apart"))


def population_equality(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many different populations the rows were evaluated on."""
    return rows.agg(F.countDistinct(F.struct(*columns)).alias("populations"))


def private_fields(schema: T.DataType, forbidden: Sequence[str], path: str = "") -> list[str]:
    """Paths of forbidden field names anywhere in a schema."""
    if isinstance(schema, T.StructType):
        found = [f"{path}{f.name}" for f in schema if f.name.lower() in forbidden]
        return found + [x for f in schema for x in private_fields(f.dataType, forbidden, f"{path}{f.name}.")]
    if isinstance(schema, T.ArrayType):
        return private_fields(schema.elementType, forbidden, path)
    if isinstance(schema, T.MapType):
        return private_fields(schema.valueType, forbidden, path)
    return []


def canonical_json(value: object) -> str:
    """Sorted, compact JSON: equal configurations have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)

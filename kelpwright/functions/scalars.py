"""Column expressions for the scalar rules of the domain."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def truthy(c: Column) -> Column:
    """1, true, yes (any case, trimmed) are true; anything else is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def flexible_timestamp(c: Column) -> Column:
    """ISO text, or `Mon Jan 02 00:00:00 -0700 2017` whatever its weekday says."""
    named = F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(named, c.try_cast("timestamp"))


def first_of_list_text(c: Column) -> Column:
    """The first element of a printed list such as "['A', 'B']"."""
    quoted = F.regexp_extract(c, r"""^\s*\[\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")""", 1)
    double = F.regexp_extract(c, r"""^\s*\[\s*"((?:[^"\\]|\\.)*)\"""", 1)
    bare = F.btrim(c, F.lit("[]'\""))
    return F.when(quoted != "", quoted).when(double != "", double).otherwise(bare)


def first_tag(c: Column, missing: int = -1) -> Column:
    """The first of comma separated tag numbers, or ``missing``."""
    return F.coalesce(F.trim(F.split(c, ",")[0]).try_cast("long"), F.lit(missing))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def day_text(ms: Column, offset_hours: int = 0) -> Column:
    """yyyymmdd of an epoch-ms instant in UTC plus an offset."""
    return F.date_format(F.timestamp_millis(ms + F.lit(offset_hours * 3_600_000)), "yyyyMMdd")


def eligible_after(upload: Column) -> Column:
    """Epoch ms of the UTC midnight after the upload date; null stays null."""
    return F.unix_date(upload).cast("long") * DAY_MS + DAY_MS


def cyclic(ms: Column, offset_hours: int = 0) -> dict[str, Column]:
    """Sine and cosine of the time of day and of the Monday-based week."""
    sec = F.floor(ms / 1000) + offset_hours * 3600
    day = F.pmod(sec, F.lit(86_400)) * (2 * math.pi / 86_400)
    # Day 0 of the epoch was a Thursday.
    week = F.pmod(sec + 3 * 86_400, F.lit(7 * 86_400)) * (2 * math.pi / (7 * 86_400))
    return {"day_sin": F.sin(day), "day_cos": F.cos(day), "week_sin": F.sin(week), "week_cos": F.cos(week)}


def right_aligned(items: Column, length: int, pad: int = -1) -> Column:
    """The last ``length`` items, padded on the left."""
    kept = F.coalesce(F.slice(items, F.greatest(F.size(items) - length + 1, F.lit(1)), length), F.array().cast("array<bigint>"))
    return F.concat(F.array_repeat(F.lit(pad).cast("long"), F.lit(length) - F.size(kept)), kept)


def pad_mask(items: Column, length: int) -> Column:
    """True where right_aligned holds an item."""
    n = F.least(F.coalesce(F.size(items), F.lit(0)), F.lit(length))
    n = F.greatest(n, F.lit(0))
    return F.concat(F.array_repeat(F.lit(False), F.lit(length) - n), F.array_repeat(F.lit(True), n))


def dot(x: Column | str, y: Column | str) -> Column:
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def weighted_cosine(x: Column, y: Column, weights: Column) -> Column:
    """Cosine of the weighted vectors; 0 where either has no length."""
    scale = lambda v: F.zip_with(v, weights, lambda a, w: a.cast("double") * w)
    a, b = scale(x), scale(y)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalized(x: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    size = norm(x)
    return F.transform(x, lambda v: v.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))

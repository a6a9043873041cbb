"""Identifier hygiene shared by the operators over logged ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line ends and the no-break space.
ID_WHITESPACE = " \t\n\r "


def trim_id(c: Column | str) -> Column:
    """The id without white space at both ends; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(ID_WHITESPACE))


def present_id(c: Column | str) -> Column:
    """The trimmed id, null where nothing is left."""
    t = trim_id(c)
    return F.when(t != "", t)

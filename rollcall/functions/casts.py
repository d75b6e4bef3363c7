"""Numbers in report text: what is no finite number gives null or a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """A double; null for blank, for other text and for nan or infinity."""
    plain = F.when(F.rlike(c, F.lit(_NUMBER)), F.trim(c))
    found = plain.try_cast("double")
    return F.when(F.abs(found) < float("inf"), found)


def whole(c: Column, default: int = 0) -> Column:
    """A long, cut towards zero; ``default`` where there is no number that fits."""
    return F.coalesce(number(c).try_cast("bigint"), F.lit(default))


def rounded(c: Column, n: int = 1) -> Column:
    """A number in ``n`` decimals; null stays null."""
    return F.round(number(c), n)

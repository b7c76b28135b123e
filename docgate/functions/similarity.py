"""Similarity of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence. A bit of one number stands for each letter of a: it is set while the row of
    the usual table doesn't rise there, so a letter of b updates a whole row with a few operations."""
    if len(a) > len(b):
        a, b = b, a
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    level = full
    for c in b:
        met = level & places.get(c, 0)
        level = (level + met | level - met) & full
    return len(a) - level.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths; 100 for two empty texts."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: ratio() of two texts as they are; null if either is."""
    return _ratio(a, b)


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 100: ratio() of the texts with their words sorted; null if either is."""
    return _ratio(sorted_words(a), sorted_words(b))


def could_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths alone allow a ratio of at least the threshold (0 to 100); cheap, before token_sort_ratio()."""
    x, y = F.length(sorted_words(a)), F.length(sorted_words(b))
    return (x + y == 0) | (200.0 * F.least(x, y) >= threshold * (x + y))

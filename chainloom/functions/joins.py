"""Joins on keys that may be null."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls match nulls; the keys of ``left`` stay, once."""
    other = right.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"__{k}" for k in keys))

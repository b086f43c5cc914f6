"""Sums whose result does not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: str) -> Column:
    """The sum of a finite double column, each value taken at eight places, as a double; nulls add nothing."""
    return F.sum(F.col(column).cast("decimal(28,8)")).cast("double")


def steady_sum(column: str) -> Column:
    """The sum of a double column of at most eight decimal places, whatever the order of the rows: two values are added as they are, more exactly.

    Where a value is no finite number below 1e19, all are added as they come.
    """
    x = F.col(column)
    fits = F.abs(x) < 1e19
    exact = F.sum(F.when(fits, x).cast("decimal(28,8)")).cast("double")
    return F.when((F.count(x) > 2) & F.bool_and(fits), exact).otherwise(F.sum(x))

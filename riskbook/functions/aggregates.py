"""Aggregate expressions with the two ways of treating missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(aggregate: Column, *inputs: Column) -> Column:
    """The aggregate, or NULL if any input value in the group is missing.

    Spark aggregates skip NULLs; a strict one must be voided by them.
    """
    complete = F.lit(True)
    for column in inputs:
        complete = complete & (F.count(column) == F.count(F.lit(1)))
    return F.when(complete, aggregate)


def null_count(column: Column) -> Column:
    return F.count(F.lit(1)) - F.count(column)


def pearson(a: Column, b: Column, strict_nulls: bool = True) -> Column:
    """Correlation; strict voids it on any missing value, else incomplete pairs are skipped.

    A column without variation has no correlation: NULL. The built-in corr
    divides by zero there, which is an error under ANSI rules.
    """
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return strict(r, a, b) if strict_nulls else r

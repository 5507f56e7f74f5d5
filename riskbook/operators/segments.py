"""Counts, default rates and means by segment.

Rows and defaults are counted in one aggregate per key instead of two
aggregates and a join. Map-side partial aggregation leaves one row per task
and key value to shuffle, so a hot key value costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.aggregates import strict
from riskbook.operators.missing import nan_to_null
from riskbook.schema import DEFAULT_LABEL


def is_default(column: str = "loan_status") -> Column:
    return F.col(column) == DEFAULT_LABEL


def count_by(df: DataFrame, key: str) -> DataFrame:
    """(key, count); a missing key is a group of its own."""
    return df.groupBy(key).count()


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(column, count) without missing values."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count()


def default_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, default_count) of the groups that have a default."""
    return df.filter(is_default()).groupBy(key).agg(F.count(F.lit(1)).alias("default_count"))


def _rate_columns(scale: float) -> list[Column]:
    rows = F.count(F.lit(1))
    # Without otherwise(): a group without defaults gets NULL, as from a left join.
    defaults = F.sum(F.when(is_default(), F.lit(1)))
    return [
        rows.alias("count"),
        defaults.alias("default_count"),
        (F.lit(float(scale)) * (defaults / rows)).alias("default_rate"),
    ]


def segment_default_rate(df: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """(key, count, default_count, default_rate); scale 100 gives percent."""
    return df.groupBy(key).agg(*_rate_columns(scale))


def segment_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(segment, value, count, default_count, default_rate) for many keys.

    All keys are read in one pass and counted by one shuffle.
    """
    status = F.col("loan_status")
    long = df.select(status, *[F.col(k).cast("string").alias(f"key_{k}") for k in keys]).unpivot(
        ["loan_status"], [f"key_{k}" for k in keys], "segment", "value"
    )
    return (
        long.groupBy("segment", "value")
        .agg(*_rate_columns(1.0))
        .withColumn("segment", F.expr("substring(segment, 5)"))
    )


def mean_by(
    df: DataFrame, key: str, value: str, where: Column | None = None, strict_nulls: bool = True
) -> DataFrame:
    """(key, mean of value); strict voids a group with a missing value."""
    rows = nan_to_null(df) if where is None else nan_to_null(df).filter(where)
    mean = F.avg(value)
    mean = strict(mean, F.col(value)) if strict_nulls else mean
    return rows.groupBy(key).agg(mean.alias(value))


def left_join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on an equally named key where a missing key matches a missing key."""
    r = right.withColumnRenamed(key, "_right_key")
    return left.join(r, left[key].eqNullSafe(r["_right_key"]), "left").drop("_right_key")

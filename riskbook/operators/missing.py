"""One idea of a missing value: NULL, which NaN becomes where a table enters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.functions.text import quoted
from riskbook.operators.batched import column_aggregates


def floating_columns(df: DataFrame) -> list[str]:
    """The columns that can hold NaN."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]


def nan_to_null(df: DataFrame) -> DataFrame:
    """The table with NULL for NaN: a projection, which unread columns don't pay for."""
    floating = floating_columns(df)
    if not floating:
        return df
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None).cast(df.schema[c].dataType)) for c in floating})


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, n_nan, frac_missing) of the table as it came, in one pass."""
    floating = set(floating_columns(df))
    counted = column_aggregates(
        df,
        list(columns or df.columns),
        {
            "n_null": "count(*) - count({c})",
            "n_nan": lambda c: f"count_if(isnan({quoted(c)}))" if c in floating else "count_if(false)",
            "n_rows": "count(*)",
        },
        buffers=2,
    )
    missing = F.try_divide(F.col("n_null") + F.col("n_nan"), F.col("n_rows"))
    return counted.select("column", "n_null", "n_nan", missing.alias("frac_missing"))

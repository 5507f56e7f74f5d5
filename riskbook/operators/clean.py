"""Filters, drops, ratios and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import ratio
from riskbook.functions.text import quoted
from riskbook.operators.batched import Statistic, column_aggregates
from riskbook.operators.missing import nan_to_null
from riskbook.schema import EXCLUDED_STATUSES, MAX_NULL_SHARE, columns_of_type


def exclude_statuses(
    df: DataFrame, column: str = "loan_status", values: Sequence[str] = tuple(EXCLUDED_STATUSES)
) -> DataFrame:
    """Rows with another status; a missing status goes too."""
    return df.filter(~F.col(column).isin(*values))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table without the named columns; names it does not have are ignored."""
    return df.drop(*names)


def screen_stats(df: DataFrame) -> dict[str, Statistic]:
    """Aggregates per column for its share of NULLs and for being constant.

    A text column is constant with one distinct value, where missing counts as
    a value; a numeric one with no spread over at least two rows, none missing.
    """
    text = set(columns_of_type(df, "character"))
    numeric = set(columns_of_type(df, "numeric"))

    def is_constant(name: str) -> str:
        c = quoted(name)
        single = f"count({c}) = count(*) and min({c}) <=> max({c})"
        if name in text:
            return f"(count(*) > 0 and (({single}) or count({c}) = 0))"
        if name in numeric:
            return f"(count(*) > 1 and {single})"
        return "(count(*) < 0)"

    return {
        "null_share": "try_divide(count(*) - count({c}), count(*))",
        "is_constant": is_constant,
    }


def screen_metrics(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """What `screen_stats` rests on, by label: one count of the rows, and each column's count and ends.

    For a pass that updates all of them on every row: fields that several
    statistics share are taken once.
    """
    comparable = {*columns_of_type(df, "character"), *columns_of_type(df, "numeric")}
    metrics = {"n_rows": "count(*)"}
    for i, name in enumerate(columns):
        c = quoted(name)
        metrics[f"n_{i}"] = f"count({c})"
        if name in comparable:
            metrics |= {f"min_{i}": f"min({c})", f"max_{i}": f"max({c})"}
    return metrics


def screened(df: DataFrame, columns: Sequence[str], seen: Mapping[str, Any]) -> tuple[dict[str, float | None], list[str]]:
    """(null share by column, constant columns) from the values of `screen_metrics`, as `screen_stats` defines them."""
    text, numeric = set(columns_of_type(df, "character")), set(columns_of_type(df, "numeric"))
    rows = seen["n_rows"]
    shares = {c: (rows - seen[f"n_{i}"]) / rows if rows else None for i, c in enumerate(columns)}

    def is_constant(i: int, name: str) -> bool:
        filled = seen[f"n_{i}"]
        single = name in text | numeric and filled == rows and seen[f"min_{i}"] == seen[f"max_{i}"]
        if name in text:
            return rows > 0 and (single or filled == 0)
        return rows > 1 and single

    return shares, [c for i, c in enumerate(columns) if is_constant(i, c)]


def column_screen(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_share, is_constant) in one pass."""
    return column_aggregates(nan_to_null(df), list(columns or df.columns), screen_stats(df), buffers=3)


def sparse_columns(df: DataFrame, max_null: float = MAX_NULL_SHARE) -> DataFrame:
    """(column, null_share) of the columns with a larger share of NULLs."""
    screen = column_screen(df)
    return screen.filter(F.col("null_share") > max_null).select("column", "null_share")


def constant_columns(df: DataFrame) -> DataFrame:
    """(column) of the columns without variation."""
    return column_screen(df).filter("is_constant").select("column")


def drop_sparse_columns(df: DataFrame, max_null: float = MAX_NULL_SHARE) -> DataFrame:
    """Without the mostly-null columns; all are kept if none is over the limit."""
    return df.drop(*[r["column"] for r in sparse_columns(df, max_null).collect()])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[r["column"] for r in constant_columns(df).collect()])


def ratio_to(df: DataFrame, columns: Sequence[str], denominator: str) -> DataFrame:
    """Each column divided by the denominator; NULL where that is zero."""
    return df.withColumns({c: ratio(F.col(c), F.col(denominator)) for c in columns})


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean) over the values present, all in one pass."""
    return column_aggregates(
        nan_to_null(df), columns, {"mean": "avg(double({c}))"}, buffers=2
    )


def fill_missing(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Replace NULLs and NaN by a value per column, as double; without a value they stay (as NULL)."""
    df = nan_to_null(df)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in values.items()}
    )


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULLs by the mean over all rows given."""
    means = {r["column"]: r["mean"] for r in column_means(df, columns).collect()}
    return fill_missing(df, means)

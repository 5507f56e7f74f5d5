"""Types of columns that no list names: logical < integer < double < text.

A column has the least type in which every filled value reads; the counts that
decide it add up over files and tasks, so one aggregate settles all columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import NUMBER_SQL, number_from_text
from riskbook.functions.text import quoted
from riskbook.operators.batched import column_aggregates

# The spellings of a logical.
TRUE_TEXTS = ["T", "TRUE", "True", "true"]
FALSE_TEXTS = ["F", "FALSE", "False", "false"]

FILLED_SQL = "nullif(nullif(trim({c}), 'NA'), '')"
_LOGICAL = ", ".join(f"'{t}'" for t in TRUE_TEXTS + FALSE_TEXTS)
_INTEGER = f"regexp_like({FILLED_SQL}, '^[+-]?[0-9]+$') and try_cast({FILLED_SQL} as bigint) is not null"
_NUMBER = f"{NUMBER_SQL.replace('{text}', FILLED_SQL)} is not null or lower({FILLED_SQL}) in ('nan', '+nan', '-nan')"


def infer_types(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, n_logical, n_integer, n_number, type) of text columns, in one pass.

    Blank text and NA don't count as filled; a column without filled values is
    logical. An integer must fit 64 bits, longer digits are a double.
    """
    counts = column_aggregates(
        raw,
        list(columns),
        {
            "filled": f"count({FILLED_SQL})",
            "n_logical": f"count_if({FILLED_SQL} in ({_LOGICAL}))",
            "n_integer": f"count_if({_INTEGER})",
            "n_number": f"count_if({_NUMBER})",
        },
    )
    filled = F.col("filled")
    least = (
        F.when(F.col("n_logical") == filled, "logical")
        .when(F.col("n_integer") == filled, "integer")
        .when(F.col("n_number") == filled, "double")
        .otherwise("text")
    )
    return counts.withColumn("type", least)


def filled_text(name: str) -> Column:
    """The trimmed text, NULL where it is blank or NA."""
    return F.expr(FILLED_SQL.replace("{c}", quoted(name)))


def typed(name: str, kind: str) -> Column:
    """A text column in one of the types above, text excepted."""
    if kind == "logical":
        value = filled_text(name)
        return F.when(value.isin(*TRUE_TEXTS), True).when(value.isin(*FALSE_TEXTS), False)
    # blank text and NA read as no number, and a cast passes over spaces, so numbers need no filled text
    value = F.col(quoted(name))
    return value.try_cast("bigint") if kind == "integer" else number_from_text(value)

"""Column summaries from mergeable sketches, in one pass and with a stated error.

A row of a sketch table describes one column of one slice (a day's load, a
month, a partition of a large table): counts, ends and sum, which are exact, a
quantile sketch and a distinct-value sketch. Slices are summarised once, kept as
a table, and merged in any grouping later without looking at the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.text import quoted, text_literal
from riskbook.operators.batched import MAX_BUFFERS
from riskbook.operators.missing import nan_to_null
from riskbook.schema import kind_of

# Size of a quantile sketch (about 8 k bytes) and the binary logarithm of a distinct sketch's size.
QUANTILE_K = 2_000
DISTINCT_LG_K = 14
# Columns that one aggregate summarises.
BATCH = 24


def rank_error(k: int = QUANTILE_K) -> float:
    """A quantile's rank is off by at most that share of the rows: three times the sketch's error at 99 %."""
    return 3 * 2.296 / k**0.9723


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """A distinct count is off by at most that share of itself: five standard errors."""
    return 5 * 1.04 / math.sqrt(2**lg_k)


def sketch_columns(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    k: int = QUANTILE_K,
    lg_k: int = DISTINCT_LG_K,
) -> DataFrame:
    """(*by, column, n, n_null, min, max, sum, quantiles, distinct) by slice and column.

    Text columns have no min, max, sum and quantiles. Sketches are begun in
    every task, so a large slice moves as one row per task.
    """
    df = nan_to_null(df)
    kinds = {c: kind_of(df.schema[c].dataType) for c in columns}

    def statistics(name: str) -> list[str]:
        c = quoted(name)
        if kinds[name] == "character":
            ends = ["double(null)", "double(null)", "double(null)", "binary(null)"]
        else:
            v = f"double({c})"
            ends = [f"min({v})", f"max({v})", f"sum({v})", f"kll_sketch_agg_double({v}, {k})"]
        # a sketch passes empty text over, so no value is handed to it empty
        return [f"count({c})", f"count(*) - count({c})", *ends, f"hll_sketch_agg('=' || string({c}), {lg_k})"]

    names = ("n", "n_null", "min", "max", "sum", "quantiles", "distinct")
    keys = [f"slice_{i}" for i in range(len(by))]

    def batch(part: Sequence[str]) -> DataFrame:
        aggregates = [
            F.expr(sql).alias(f"{name}_{i}") for i, c in enumerate(part) for name, sql in zip(names, statistics(c))
        ]
        sliced = df.groupBy(*[F.col(b).alias(a) for a, b in zip(keys, by)]).agg(*aggregates)
        rows = [
            f"named_struct('column', {text_literal(c)}, " + ", ".join(f"'{n}', {n}_{i}" for n in names) + ")"
            for i, c in enumerate(part)
        ]
        return sliced.selectExpr(*[f"{a} as {quoted(b)}" for a, b in zip(keys, by)], f"inline(array({', '.join(rows)}))")

    parts = [batch(list(columns)[i : i + BATCH]) for i in range(0, len(columns), BATCH)]
    return reduce(DataFrame.unionAll, parts)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of larger slices, or of the whole table, from those of smaller ones."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"),
        F.sum("n_null").alias("n_null"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("sum"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(..., column, n, share, value) of numeric columns with values: the rank is off by `rank_error` of n at most."""
    # text columns, and those without a value, have no least value either
    known = sketches.filter(F.col("min").isNotNull())
    others = [c for c in known.columns if c not in ("n_null", "min", "max", "sum", "distinct", "quantiles")]
    found = [F.struct(F.lit(float(s)).alias("share"), _quantile(s).alias("value")) for s in shares]
    return known.select(*others, F.inline(F.array(*found)))


def _quantile(share: float) -> Column:
    return F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(share))))


def sketched_summary(sketches: DataFrame) -> DataFrame:
    """(..., column, min, q1, median, mean, q3, max, n_null, n_distinct); missing counts as a value."""
    keys = [c for c in sketches.columns if c not in ("n", "n_null", "min", "max", "sum", "quantiles", "distinct")]
    return sketches.select(
        *keys,
        "min",
        _quantile(0.25).alias("q1"),
        _quantile(0.5).alias("median"),
        F.try_divide("sum", "n").alias("mean"),
        _quantile(0.75).alias("q3"),
        "max",
        "n_null",
        distinct_estimate().alias("n_distinct"),
    )


def distinct_estimate() -> Column:
    """Distinct values of a sketch row; missing counts as one."""
    return F.hll_sketch_estimate("distinct") + (F.col("n_null") > 0).cast("int")


def ranks_of(df: DataFrame, values: dict[str, Sequence[float]]) -> DataFrame:
    """(column, position, below, upto): exact shares of each column's values below and up to the given ones."""
    df = nan_to_null(df)
    parts = []
    names = list(values)
    # a column takes a count, and two more for each value
    size = max(1, MAX_BUFFERS // (1 + 2 * max(map(len, values.values()), default=0)))
    for i in range(0, len(names), size):
        counts, rows = [], []
        for j, c in enumerate(names[i : i + size]):
            v = F.col(quoted(c)).cast("double")
            counts.append(F.count(v).alias(f"n_{j}"))
            for p, at in enumerate(values[c]):
                counts += [F.count_if(v < at).alias(f"b_{j}_{p}"), F.count_if(v <= at).alias(f"u_{j}_{p}")]
                rows.append(
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(p).alias("position"),
                        F.try_divide(f"b_{j}_{p}", f"n_{j}").alias("below"),
                        F.try_divide(f"u_{j}_{p}", f"n_{j}").alias("upto"),
                    )
                )
        parts.append(df.agg(*counts).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionAll, parts)

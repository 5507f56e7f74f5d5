"""Column profiles: shape, summaries, nulls, distinct values, ranges, histograms.

NaN counts as missing throughout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import bin_index_sql
from riskbook.functions.text import double_literal, quoted, text_literal
from riskbook.operators.batched import MAX_BUFFERS, column_aggregates
from riskbook.operators.missing import nan_to_null
from riskbook.operators.quantiles import as_numbers, interpolated_quantiles
from riskbook.schema import DEFAULT_LABEL, PAID_LABEL, columns_of_type, kind_of


NULL_COUNT = "count(*) - count({c})"


def profile_shape(df: DataFrame, key: str | None = None, samples: int = 0) -> DataFrame:
    """(position, column, type, n_rows): the schema with one count; with `samples`, also `sample`.

    A sample shows the column's values in the first rows by key, as text:
    numbers to four places, text in quotes, NA for missing ones. Each task keeps
    only its own first rows.
    """
    rows = ", ".join(
        f"named_struct('position', {i}, 'column', {text_literal(f.name)},"
        f" 'type', '{kind_of(f.dataType)}')"
        for i, f in enumerate(df.schema.fields, start=1)
    )
    shape = df.selectExpr("count(*) as n_rows").selectExpr(f"inline(array({rows}))", "n_rows")
    if not samples:
        return shape
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    shown = ", ".join(_shown(c, kind) for c, kind in kinds.items())
    first = nan_to_null(preview(df, key, samples)).selectExpr(
        f"struct({quoted(key)}, array({shown}) as shown) as row"
    )
    # At most `samples` rows from here on.
    listed = first.agg(F.sort_array(F.collect_list("row"))["shown"].alias("rows")).select(
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(kinds) - 1)), lambda i: F.array_join(
            F.transform("rows", lambda r: r[i]), ", "))).alias("at", "sample")
    )
    joined = shape.join(F.broadcast(listed), F.col("position") == F.col("at") + 1)
    return joined.drop("at")


def _shown(name: str, kind: str) -> str:
    value = quoted(name)
    text = {
        "character": f"concat('\"', {value}, '\"')",
        "numeric": f"string(try_cast(round({value}, 4) as decimal(38, 4)))",
    }.get(kind, f"string({value})")
    return f"coalesce({text}, 'NA')"


def preview(df: DataFrame, key: str, n: int = 6) -> DataFrame:
    """The first n rows by key; each task keeps only its own first n."""
    return df.orderBy(key).limit(n)


def summarize_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min, q1, median, mean, q3, max, n_null) of numeric columns; exact quartiles.

    NaN counts as missing in all of them.
    """
    columns = list(columns or columns_of_type(df, "numeric"))
    quartiles = interpolated_quantiles(df, columns, ["0.25", "0.5", "0.75"])

    value = as_numbers(df, columns)
    stats = column_aggregates(
        df,
        columns,
        {
            "min": lambda c: f"min({value[c]})",
            "mean": lambda c: f"avg({value[c]})",
            "max": lambda c: f"max({value[c]})",
            "n_null": lambda c: f"count(*) - count({value[c]})",
        },
        buffers=6,
    )
    known = df.sparkSession.createDataFrame(
        [(c, *map(_float, qs)) for c, qs in quartiles.items()],
        "column string, q1 double, median double, q3 double",
    )
    # Both sides have one row per column of the table.
    return stats.join(F.broadcast(known), "column").select(
        "column", "min", "q1", "median", "mean", "q3", "max", "n_null"
    )


def summarize_text(df: DataFrame) -> DataFrame:
    """(column, length, class, n_null) of text columns: what a summary says of them."""
    columns = columns_of_type(df, "character")
    counted = column_aggregates(df, columns, {"length": "count(*)", "n_null": NULL_COUNT})
    return counted.select("column", "length", F.lit("character").alias("class"), "n_null")


def _float(value: float | None) -> float | None:
    return None if value is None else float(value)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, frac_null, any_null)."""
    counted = column_aggregates(
        nan_to_null(df),
        list(columns or df.columns),
        {"n_null": NULL_COUNT, "n_rows": "count(*)"},
        buffers=1,
    )
    return counted.select(
        "column",
        "n_null",
        F.try_divide(F.col("n_null"), F.col("n_rows")).alias("frac_null"),
        (F.col("n_null") > 0).alias("any_null"),
    )


def distinct_values(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """The distinct values, missing included.

    With a key, in the order in which the rows by key first show them: a
    second column `first_seen` has the smallest key of each value. The values
    are sorted in ranges, so neither they nor a frequent one meet in one task.
    """
    df = nan_to_null(df)
    if key is None:
        return df.select(column).distinct()
    return df.groupBy(column).agg(F.min(key).alias("first_seen")).orderBy("first_seen", column)


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """(column, n_distinct); missing counts as one value.

    Exactly, values are made distinct as (column, value) pairs, first within
    each task, so no task has to hold the values of a whole column. All pairs are
    shuffled, though: for a wide table of many terabytes the approximation,
    which moves only sketches, is the choice.
    """
    df, columns = nan_to_null(df), list(columns or df.columns)
    if approximate:
        with_null = "approx_count_distinct({c}) + int(count(*) > count({c}))"
        return column_aggregates(df, columns, {"n_distinct": with_null}, buffers=8)
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            kind = {"integer": "bigint", "numeric": "double"}.get(kind_of(f.dataType), "string")
            if f.dataType.typeName() == "decimal":
                kind = "string"  # a double would merge values
            groups.setdefault(kind, []).append(f.name)
    parts = [
        df.select(*[F.col(c).cast(kind).alias(c) for c in names])
        .unpivot([], names, "column", "value")
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
        for kind, names in groups.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def std_by_column(
    df: DataFrame, columns: Sequence[str] | None = None, strict_nulls: bool = True
) -> DataFrame:
    """(column, std): sample standard deviation; strict voids it on any missing value."""

    std = "stddev_samp(double({c}))"
    if strict_nulls:
        std = f"case when count({{c}}) = count(*) then {std} end"
    return column_aggregates(
        nan_to_null(df), list(columns or columns_of_type(df, "numeric")), {"std": std}, buffers=5
    )


def range_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, n_null)."""
    return column_aggregates(
        nan_to_null(df),
        columns,
        {
            "min": "double(min({c}))",
            "max": "double(max({c}))",
            "n_null": NULL_COUNT,
        },
        buffers=4,
    )


def class_means(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "loan_status",
    strict_nulls: bool | Sequence[str] = False,
) -> DataFrame:
    """(column, mean_paid, mean_default) among the exactly so labelled rows.

    One grouped pass for both classes, with sums and a count per column. Whole
    and broken parts are summed apart, so that the order of the rows does not
    show in a mean that ends in a 5. A strict mean is void if its class has a missing value in the column;
    ``strict_nulls`` may also name the strict columns.
    """
    columns = list(columns)
    strict = set(columns if strict_nulls is True else strict_nulls or [])
    of_class = nan_to_null(df).filter(F.col(label).isin(PAID_LABEL, DEFAULT_LABEL))
    classes = {"mean_paid": PAID_LABEL, "mean_default": DEFAULT_LABEL}

    def mean_of(name: str) -> str:
        c = quoted(name)
        whole = f"rint(double({c}))"
        broken = f"case when abs(double({c})) < {2**53}D then double({c}) - {whole} else 0D end"
        # 0D of a missing value does not count, since the sum of whole parts is NULL without values
        mean = f"try_divide(sum({whole}) + sum({broken}), count({c}))"
        return f"case when count({c}) = count(*) then {mean} end" if name in strict else mean

    parts = []
    size = MAX_BUFFERS // 3
    for i in range(0, len(columns), size):
        part = columns[i : i + size]
        by_class = of_class.groupBy(F.col(label).alias("class")).agg(
            *[F.expr(mean_of(c)).alias(f"m{j}") for j, c in enumerate(part)]
        )
        # At most two rows from here on.
        means = [
            F.max(F.when(F.col("class") == value, F.col(f"m{j}"))).alias(f"{out}_{j}")
            for j in range(len(part))
            for out, value in classes.items()
        ]
        rows = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"{out}_{j}").alias(out) for out in classes])
            for j, c in enumerate(part)
        ]
        parts.append(by_class.agg(*means).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionAll, parts)


def pretty_breaks(low: float, high: float, n_bins: int) -> list[float]:
    """Equally spaced round numbers over the range, about n_bins intervals.

    The step is 1, 2, 5 or 10 times a power of ten, with the usual preference
    for the smaller steps.
    """
    span = high - low
    if span <= 0:
        return [low - 0.5, low + 0.5]
    cell = span / max(1, n_bins)
    base = 10.0 ** math.floor(math.log10(cell))
    step = base
    for multiple, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if multiple * base - cell < bias * (cell - step):
            step = multiple * base
    first, last = math.floor(low / step + 1e-7), math.ceil(high / step - 1e-7)
    digits = max(0, 1 - math.floor(math.log10(step)))
    return [round(i * step, digits) for i in range(first, last + 1)]


def default_breaks(df: DataFrame, column: str) -> list[float]:
    """Round breaks for 1 + log2(n) bins over the range of the column's finite values."""
    value = F.col(column).cast("double")
    c = F.when(F.abs(value) < float("inf"), value)
    row = df.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n")).first()
    if not row["n"]:
        return [0.0, 1.0]
    return pretty_breaks(row["low"], row["high"], math.ceil(math.log2(row["n"]) + 1))


def histogram(df: DataFrame, column: str, breaks: Sequence[float] | None = None) -> DataFrame:
    """(bin, lower, upper, count) with bins closed on the right, the first on both sides.

    Empty bins are listed, missing values are not counted. Values outside given
    breaks are counted in two more rows: bin 0 has no lower and the last bin no
    upper bound. Without breaks they are chosen from the range and the row
    count, and hold every value; infinite ones are counted in the outer bins.
    """
    df = nan_to_null(df)
    open_ended = breaks is not None
    breaks = [float(b) for b in (breaks or default_breaks(df, column))]
    value = F.col(column).cast("double")
    last = len(breaks)
    inside = f"greatest({bin_index_sql('value', breaks, 'right')}, 1)"
    place = f"""case when value < {double_literal(breaks[0])} then 0
 when value > {double_literal(breaks[-1])} then {last} else {inside} end"""
    if not open_ended:
        place = f"least({inside}, {last - 1})"
    counts = (
        df.select(value.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(F.expr(place).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    listed = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]), start=1)]
    if open_ended:
        listed = [(0, None, breaks[0]), *listed, (last, breaks[-1], None)]
    bins = df.sparkSession.createDataFrame(listed, "bin int, lower double, upper double")
    # counts has at most one row per bin.
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("count")
    )

"""Correlations, weight of evidence and information value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.functions.aggregates import pearson
from riskbook.functions.columns import bin_index_sql
from riskbook.functions.text import quoted
from riskbook.operators.missing import nan_to_null
from riskbook.operators.quantiles import discrete_quantiles
from riskbook.schema import columns_of_type


def pearson_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]], strict_nulls: bool = True
) -> DataFrame:
    """(var_a, var_b, r) for many pairs in one pass."""
    wide = nan_to_null(df).agg(
        *[
            pearson(F.col(a), F.col(b), strict_nulls).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = [
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(var_a, var_b, r) for all pairs, over the rows complete in all columns.

    r is NULL for a column without variation, and everywhere when no row is
    complete. The matrix has one cell per pair of columns and is the only thing
    that reaches the driver.
    """
    spark = df.sparkSession
    columns = list(columns or columns_of_type(df, "numeric"))
    complete = nan_to_null(df).select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    ends = complete.agg(
        F.count(F.lit(1)).alias("n"), *[(F.min(c) == F.max(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    matrix = None
    if ends["n"]:
        vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(complete)
        matrix = Correlation.corr(vectors.select("v"), "v").first()[0].toArray()

    def cell(i: int, j: int) -> float | None:
        r = None if matrix is None else float(matrix[i, j])
        return None if r is None or r != r else r

    size = range(len(columns))
    # A constant column has no correlation with itself either.
    constant = [bool(ends[f"c{i}"]) for i in size]
    return spark.createDataFrame(
        [
            (columns[i], columns[j], None if constant[i] or constant[j] else cell(i, j))
            for i in size
            for j in size
        ],
        "var_a string, var_b string, r double",
    )


def correlated_pairs(matrix: DataFrame, min_abs_r: float) -> DataFrame:
    """Each pair once, if its correlation is at least that strong."""
    return matrix.filter((F.col("var_a") < F.col("var_b")) & (F.abs("r") >= min_abs_r))


def prune_order(matrix: DataFrame, target: str, protected: Sequence[str] = ()) -> list[str]:
    """The columns of a matrix by worth: the protected ones as given, then by correlation with the target.

    Equal correlations (to nine digits) go by name; a column without one comes last.
    """
    rows = matrix.filter((F.col("var_b") == target) & (F.col("var_a") != target)).collect()
    strength = {r["var_a"]: None if r["r"] is None else round(abs(r["r"]), 9) for r in rows}
    first = [c for c in protected if c in strength]
    rest = sorted(set(strength) - set(first), key=lambda c: (strength[c] is None, -(strength[c] or 0.0), c))
    return first + rest


def prune_correlated(
    matrix: DataFrame, min_abs_r: float, order: Sequence[str], protected: Sequence[str] = ()
) -> DataFrame:
    """(column, kept_column, r): the columns that go, each with the kept one it is closest to.

    Strong pairs make a graph of the columns. In the given order a column stays
    unless it forms a strong pair (to nine digits) with one that stays already;
    so no two of the kept ones are strong, and each that goes has a kept stand-in.
    Protected columns always stay. The graph has at most a cell of the matrix per
    pair and is settled on the driver.
    """
    strong: dict[str, dict[str, float]] = {}
    pairs = matrix.filter((F.col("var_a") != F.col("var_b")) & (F.round(F.abs("r"), 9) >= min_abs_r))
    for row in pairs.collect():
        strong.setdefault(row["var_a"], {})[row["var_b"]] = row["r"]
    kept: dict[str, None] = {}
    gone = []
    for c in order:
        rivals = {k: r for k, r in strong.get(c, {}).items() if k in kept}
        if c in protected or not rivals:
            kept[c] = None
            continue
        nearest = min(rivals, key=lambda k: (-round(abs(rivals[k]), 9), k))
        gone.append((c, nearest, rivals[nearest]))
    return matrix.sparkSession.createDataFrame(gone, "column string, kept_column string, r double")


def woe_table(df: DataFrame, target: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(variable, bin, n, n1, n0, woe, iv) against a 0/1 target.

    Numeric columns are cut at their exact quantiles, text columns go by
    level, missing values are a bin of their own (NULL). A bin without rows of
    one class has woe and iv 0. Every column has the same class totals, since
    missing values are counted too; they are taken once.
    """
    df = nan_to_null(df)
    text = [c for c in columns if c in columns_of_type(df, "character")]
    numeric = [c for c in columns if c not in text]
    shares = [f"{i}/{bins}" for i in range(1, bins)]
    cuts = discrete_quantiles(df, numeric, shares) if numeric else {}

    rows = df.filter(F.col(target).isNotNull())
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("n1")).first()
    all1 = totals["n1"] or 0
    all0 = totals["n"] - all1
    y = f"int({quoted(target)}) as _y"
    binned = []
    if numeric:
        indexes = [
            f"{bin_index_sql(c, sorted(set(cuts[c])))} as {quoted(c)}" for c in numeric
        ]
        binned.append((rows.selectExpr(y, *indexes), numeric))
    if text:
        binned.append((rows.selectExpr(y, *map(quoted, text)), text))

    def count(part: DataFrame, names: list[str]) -> DataFrame:
        long = part.unpivot(["_y"], names, "variable", "bin")
        return long.groupBy("variable", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n1")
        ).withColumn("bin", F.col("bin").cast("string"))

    if not binned:
        raise ValueError("no column left to bin")
    grouped = reduce(DataFrame.unionAll, [count(*b) for b in binned])

    n1, n0 = F.col("n1"), F.col("n0")
    filled = (n1 > 0) & (n0 > 0)
    return (
        grouped.withColumn("n0", F.col("n") - F.col("n1"))
        .withColumns({"p1": F.try_divide(n1, F.lit(all1)), "p0": F.try_divide(n0, F.lit(all0))})
        .withColumn("woe", F.when(filled, F.log(F.col("p1") / F.col("p0"))).otherwise(0.0))
        .withColumn("iv", (F.col("p1") - F.col("p0")) * F.col("woe"))
        .select("variable", "bin", "n", "n1", "n0", "woe", "iv")
    )


def information_value(woe: DataFrame) -> DataFrame:
    """(variable, iv): the sum over the bins of a WOE table."""
    return woe.groupBy("variable").agg(F.sum("iv").alias("iv"))

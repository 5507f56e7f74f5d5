"""Linear models: fitting, summaries, scoring and evaluation.

Spark ML fits (one pass of normal equations over the training rows). Scores
are plain column expressions made from the coefficients, so scoring a book is
a projection without a shuffle, and a row with a missing predictor or an
unknown level keeps its place with a NULL score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.functions.columns import bin_index_sql
from riskbook.operators.absorb import AbsorbedModel, fit_absorbed
from riskbook.operators.quantiles import discrete_quantiles
from riskbook.schema import PREDICTORS, columns_of_type

# The normal equations hold at most this many features.
MAX_FEATURES = 4096

COEFFICIENT_SCHEMA = "term string, estimate double, std_error double, t_value double, p_value double"


@dataclass(frozen=True)
class LinearModel:
    """A fitted linear model; a level's effect is relative to the first level."""

    target: str
    intercept: float
    slopes: dict[str, float]
    effects: dict[str, dict[str, float]] = field(default_factory=dict)
    # (term, estimate, std_error, t_value, p_value)
    coefficients: tuple[tuple, ...] = ()

    @property
    def predictors(self) -> list[str]:
        return [*self.effects, *self.slopes]

    def prediction(self) -> Column:
        score = F.lit(self.intercept)
        for name, effects in self.effects.items():
            levels = F.create_map(*[F.lit(x) for pair in effects.items() for x in pair])
            score = score + F.try_element_at(levels, F.col(name))
        for name, slope in self.slopes.items():
            score = score + F.lit(slope) * F.col(name).cast("double")
        return score


Model = LinearModel | AbsorbedModel


class TooManyLevels(ValueError):
    """Text predictors have more levels than the normal equations hold."""


def category_levels(df: DataFrame, columns: Sequence[str], most: int = MAX_FEATURES) -> dict[str, list[str]]:
    """The sorted levels of each column, in one pass; more than `most` in all are an error."""
    if not columns:
        return {}
    rows = (
        df.select(*columns)
        .unpivot([], list(columns), "column", "level")
        .filter(F.col("level").isNotNull())
        .distinct()
        .limit(most + 1)
        .collect()
    )
    if len(rows) > most:
        raise TooManyLevels(f"more than {most} levels in {list(columns)}")
    return {c: sorted(r["level"] for r in rows if r["column"] == c) for c in columns}


def fit_ols(
    train: DataFrame,
    target: str,
    predictors: Sequence[str] = tuple(PREDICTORS),
) -> LinearModel:
    """Least squares with an intercept; text predictors enter as levels; `fit` takes any number of them.

    The alphabetically first level is the baseline. Rows with a missing value
    are left out. A level that no training row has is unknown to the model: its
    rows get no score. More than MAX_FEATURES features are an error.
    """
    rows = train.select(F.col(target).cast("double").alias("label"), *predictors).na.drop()
    text = [p for p in predictors if p in columns_of_type(train, "character")]
    numeric = [p for p in predictors if p not in text]

    levels = category_levels(rows, text, MAX_FEATURES - len(numeric))
    # Descending order with the last index dropped drops the first level.
    labels = [levels[c][::-1] for c in text]
    stages = [
        *[
            StringIndexerModel.from_labels(found, inputCol=c, outputCol=f"{c}_index")
            for c, found in zip(text, labels)
        ],
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in text],
            outputCols=[f"{c}_levels" for c in text],
        ),
    ] if text else []
    inputs = [f"{c}_levels" for c in text] + numeric
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        LinearRegression(solver="normal", regParam=0.0, fitIntercept=True),
    ]
    fitted = Pipeline(stages=stages).fit(rows)
    regression = fitted.stages[-1]

    names: list[tuple[str, str | None]] = []
    effects: dict[str, dict[str, float]] = {}
    weights = [float(w) for w in regression.coefficients.toArray()]
    for c, found in zip(text, labels):
        *others, baseline = found
        effects[c] = {baseline: 0.0}
        effects[c] |= {lv: weights[len(names) + i] for i, lv in enumerate(others)}
        names += [(c, lv) for lv in others]
    slopes = {c: weights[len(names) + i] for i, c in enumerate(numeric)}
    terms = [f"{c}{lv}" for c, lv in names] + numeric

    try:
        summary = regression.summary
        errors = list(summary.coefficientStandardErrors)
        t_values, p_values = list(summary.tValues), list(summary.pValues)
    except Exception as error:
        # Collinear predictors: coefficients exist, their errors do not.
        if "No Std. Error" not in str(error):
            raise
        errors = t_values = p_values = [None] * (len(terms) + 1)
    estimates = [*weights, float(regression.intercept)]
    table = list(zip([*terms, "(Intercept)"], estimates, errors, t_values, p_values))
    return LinearModel(
        target=target,
        intercept=float(regression.intercept),
        slopes=slopes,
        effects=effects,
        coefficients=(table[-1], *sorted(table[:-1], key=lambda r: r[0])),
    )


def fit(
    train: DataFrame, target: str, predictors: Sequence[str] = tuple(PREDICTORS), most: int = MAX_FEATURES
) -> LinearModel | AbsorbedModel:
    """Least squares; with more than `most` features the text predictor with most levels is absorbed."""
    text = [p for p in predictors if p in columns_of_type(train, "character")]
    if not text:
        return fit_ols(train, target, predictors)
    counts = train.agg(*[F.approx_count_distinct(c).alias(c) for c in text]).first()
    widest = max(text, key=lambda c: (counts[c], c))
    # the approximation is off by some percent, so near the limit the exact way decides
    if sum(counts) < most / 2:
        return fit_ols(train, target, predictors)
    try:
        category_levels(train, text, most - len(predictors) + len(text))
    except TooManyLevels:
        others = [c for c in text if c != widest]
        rows = train.select(F.col(target), *predictors).na.drop()
        return fit_absorbed(train, target, widest, predictors, category_levels(rows, others, most))
    return fit_ols(train, target, predictors)


def coefficient_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """(term, estimate, std_error, t_value, p_value), one row per coefficient."""
    return spark.createDataFrame([tuple(r) for r in model.coefficients], COEFFICIENT_SCHEMA)


def score(model: LinearModel | AbsorbedModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """The table with the model's prediction, unclipped."""
    if isinstance(model, AbsorbedModel):
        return model.score(df, out)
    return df.withColumn(out, model.prediction())


def fit_stats(model: LinearModel, train: DataFrame) -> DataFrame:
    """One row of summary statistics over the training rows, in one pass.

    deviance is the residual and null_deviance the total sum of squares,
    dispersion the residual variance.
    """
    y, p = F.col(model.target).cast("double"), F.col("_fit")
    sums = (
        score(model, train, "_fit")
        .filter(p.isNotNull() & y.isNotNull())
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((y - p) * (y - p)).alias("deviance"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("null_deviance"),
        )
    )
    if isinstance(model, AbsorbedModel):
        k = len(model.features) + model.levels.count() - 1
    else:
        k = len(model.coefficients) - 1
    n, sse, sst = F.col("n"), F.col("deviance"), F.col("null_deviance")
    df_resid = n - (k + 1)
    r2 = 1 - F.try_divide(sse, sst)
    return sums.select(
        "n",
        F.lit(k).alias("df_model"),
        df_resid.cast("bigint").alias("df_residual"),
        r2.alias("r2"),
        (1 - F.try_divide((1 - r2) * (n - 1), df_resid)).alias("r2_adjusted"),
        F.try_divide((sst - sse) / max(k, 1), F.try_divide(sse, df_resid)).alias("f_statistic"),
        F.sqrt(F.try_divide(sse, df_resid)).alias("sigma"),
        F.try_divide(sse, df_resid).alias("dispersion"),
        "null_deviance",
        "deviance",
        (n * (F.log(F.lit(2 * math.pi) * F.try_divide(sse, n)) + 1) + 2 * (k + 2)).alias("aic"),
    )


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(predicted, actual, count) with all four cells of a 0/1 outcome."""
    cells = [(p, a) for p in (0, 1) for a in (0, 1)]
    wide = df.agg(
        *[
            F.count(F.when((F.col(predicted) == p) & (F.col(actual) == a), F.lit(1))).alias(f"c{p}{a}")
            for p, a in cells
        ]
    )
    rows = [
        F.struct(
            F.lit(p).alias("predicted"), F.lit(a).alias("actual"), F.col(f"c{p}{a}").alias("count")
        )
        for p, a in cells
    ]
    return wide.select(F.inline(F.array(*rows)))


def accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(accuracy): share of rows with equal classes, missing ones left out."""
    hit = (F.col(predicted) == F.col(actual)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def error_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(abs_mean_error, rmse)."""
    e = F.col(actual).cast("double") - F.col(predicted)
    return df.agg(F.abs(F.avg(e)).alias("abs_mean_error"), F.sqrt(F.avg(e * e)).alias("rmse"))


def with_residual(df: DataFrame, actual: str, predicted: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(actual).cast("double") - F.col(predicted))


def residual_trend(df: DataFrame, predicted: str, residual: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prediction, mean_abs_residual) over quantile bins of the prediction."""
    shares = [f"{i}/{bins}" for i in range(1, bins)]
    cuts = sorted(set(discrete_quantiles(df, [predicted], shares)[predicted]))
    return (
        df.filter(F.col(predicted).isNotNull() & F.col(residual).isNotNull())
        .groupBy(F.expr(bin_index_sql(predicted, cuts)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(predicted).alias("mean_prediction"),
            F.avg(F.abs(F.col(residual))).alias("mean_abs_residual"),
        )
    )

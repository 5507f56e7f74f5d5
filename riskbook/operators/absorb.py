"""Least squares with one text predictor of any number of levels.

Taking the level means off every column leaves a regression on the other
predictors alone, with the same slopes; a level's effect is then its mean of
the target less what the slopes say of its other means. The cross products
about the level means come from covariances per level, which tasks merge, so
the fit is one grouped aggregate and the driver solves as many equations as
there are other features. The levels stay a table; scores are a join on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.operators.missing import nan_to_null
from riskbook.schema import columns_of_type
from riskbook.sources.staging import stage

# Levels with more than this share of the training rows are hot: fewer than
# HOT_SHARE of them.
HOT_SHARE = 1_000


@dataclass(frozen=True)
class AbsorbedModel:
    """A fit whose level effects are a table (level, n, effect, means), staged."""

    target: str
    level: str
    features: tuple[tuple[str, str, str | None], ...]  # (term, column, level or None)
    slopes: tuple[float, ...]
    inverse: np.ndarray  # of the cross products of the features
    variance: float | None  # of the residuals
    levels: DataFrame

    @property
    def predictors(self) -> list[str]:
        return [self.level, *dict.fromkeys(c for _, c, _ in self.features)]

    def _rest(self) -> Column:
        total = F.lit(0.0)
        for (_, column, level), slope in zip(self.features, self.slopes):
            total = total + F.lit(slope) * _value(column, level)
        return total

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """The table with the prediction; NULL for an unknown level or a missing value."""
        df = nan_to_null(df)
        effects = self.levels.select(F.col("level").alias("_level"), F.col("effect").alias("_effect"), "hot")
        hot = F.broadcast(effects.filter("hot").drop("hot"))
        cold = effects.filter(~F.col("hot")).drop("hot")
        same = F.col(self.level) == F.col("_level")
        # hot levels are matched where the rows are, so none of them meets in one task
        joined = df.join(hot, same).unionAll(df.join(hot, same, "left_anti").join(cold, same, "left"))
        return joined.withColumn(out, F.col("_effect") + self._rest()).drop("_level", "_effect")

    def coefficients(self) -> DataFrame:
        """(term, estimate, std_error, t_value) of the other features."""
        spark = self.levels.sparkSession
        rows = []
        for i, ((term, _, _), slope) in enumerate(zip(self.features, self.slopes)):
            error = None if self.variance is None else float(np.sqrt(self.variance * self.inverse[i, i]))
            rows.append((term, slope, error, slope / error if error else None))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double")

    def level_effects(self) -> DataFrame:
        """(level, n, effect, std_error): each level's own intercept."""
        spread = F.try_divide(F.lit(1.0), F.col("n"))
        for i in range(len(self.features)):
            for j in range(len(self.features)):
                spread = spread + F.col("means")[i] * F.col("means")[j] * float(self.inverse[i, j])
        error = F.sqrt(spread * F.lit(self.variance).cast("double"))
        return self.levels.select("level", "n", "effect", error.alias("std_error"))


def _value(column: str, level: str | None) -> Column:
    return F.col(column).cast("double") if level is None else (F.col(column) == level).cast("double")


def fit_absorbed(
    train: DataFrame, target: str, level: str, predictors: Sequence[str], other_levels: dict[str, list[str]] | None = None
) -> AbsorbedModel:
    """Least squares with the level column absorbed; other text predictors enter by the levels given.

    Rows with a missing value are left out. The alphabetically first of the other
    levels is their baseline. Features that the levels explain get slope 0.
    """
    text = set(columns_of_type(train, "character"))
    numeric = [p for p in predictors if p != level and p not in text]
    features = [(c, c, None) for c in numeric]
    for c, found in (other_levels or {}).items():
        features += [(f"{c}{v}", c, v) for v in sorted(found)[1:]]
    values = [_value(c, v).alias(f"x{i}") for i, (_, c, v) in enumerate(features)]
    y = F.col(target).cast("double").alias("y")
    rows = nan_to_null(train).select(F.col(level).alias("level"), y, *values).na.drop()

    names = [f"x{i}" for i in range(len(features))] + ["y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    n = F.count(F.lit(1))
    grouped = rows.groupBy("level").agg(
        n.alias("n"),
        *[F.avg(a).alias(f"mean_{a}") for a in names],
        *[(F.covar_pop(a, b) * n).alias(f"{a}_{b}") for a, b in pairs],
    )
    grouped = stage(grouped, "level-sums")
    total = grouped.agg(
        F.count(F.lit(1)).alias("levels"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a, b in pairs]
    ).first()
    size = len(features)
    products = np.zeros((size + 1, size + 1))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        products[i, j] = products[j, i] = total[f"{a}_{b}"] or 0.0
    inner, outer = products[:size, :size], products[:size, size]
    scale = np.sqrt(np.where(np.diag(inner) > 0, np.diag(inner), 1.0))
    inverse = np.linalg.pinv(inner / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    slopes = inverse @ outer
    free = total["n"] - total["levels"] - size
    error = float(products[size, size] - slopes @ outer)

    effect = F.col("mean_y")
    for i, slope in enumerate(slopes):
        effect = effect - F.lit(float(slope)) * F.col(f"mean_x{i}")
    levels = grouped.select(
        "level",
        "n",
        effect.alias("effect"),
        F.array(*[F.col(f"mean_x{i}") for i in range(size)]).cast("array<double>").alias("means"),
        (F.col("n") * HOT_SHARE > int(total["n"])).alias("hot"),
    )
    return AbsorbedModel(
        target, level, tuple(features), tuple(map(float, slopes)), inverse, error / free if free > 0 else None, levels
    )

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from riskbook.operators import models

SCHEMA = "y double, sub_grade string, term string, int_rate double, dti double"


def make_rows(n=400):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        g, t = rng.choice(["A1", "A2", "B1", "C1"]), rng.choice([" 36 months", " 60 months"])
        r, d = rng.uniform(5, 25), rng.uniform(0, 40)
        y = 0.3 + 0.1 * "A1A2B1C1".index(g) - 0.2 * (t == " 60 months") - 0.01 * r + rng.gauss(0, 0.1)
        rows.append((y, g, t, r, d))
    return rows


ROWS = make_rows()


def design(rows):
    x = [
        [1.0, g == "A2", g == "B1", g == "C1", t == " 60 months", r, d]
        for _, g, t, r, d in rows
    ]
    return np.array(x, dtype=float), np.array([row[0] for row in rows])


@pytest.fixture(scope="module")
def train(frame):
    return frame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def model(train):
    return models.fit_ols(train, "y")


def test_coefficients_against_numpy(spark, model):
    x, y = design(ROWS)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    s2 = residual @ residual / (len(y) - x.shape[1])
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    names = ["(Intercept)", "sub_gradeA2", "sub_gradeB1", "sub_gradeC1", "term 60 months", "int_rate", "dti"]
    table = models.coefficient_table(spark, model)
    assert as_dict(table, "term", "estimate") == pytest.approx(dict(zip(names, beta)))
    assert as_dict(table, "term", "std_error") == pytest.approx(dict(zip(names, errors)))
    assert as_dict(table, "term", "t_value") == pytest.approx(dict(zip(names, beta / errors)))
    p = as_dict(table, "term", "p_value")
    assert 0 <= p["term 60 months"] < 1e-6 and 0 <= p["dti"] <= 1


def test_first_level_is_the_baseline(model):
    assert model.effects["sub_grade"]["A1"] == 0.0
    assert model.effects["term"][" 36 months"] == 0.0
    assert set(model.effects["sub_grade"]) == {"A1", "A2", "B1", "C1"}


def test_fit_stats(train, model):
    x, y = design(ROWS)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    sse, sst, n, k = float(((y - x @ beta) ** 2).sum()), float(((y - y.mean()) ** 2).sum()), len(y), 6
    s = models.fit_stats(model, train).first()
    assert (s["n"], s["df_model"], s["df_residual"]) == (n, k, n - k - 1)
    assert s["r2"] == pytest.approx(1 - sse / sst)
    assert s["r2_adjusted"] == pytest.approx(1 - (sse / sst) * (n - 1) / (n - k - 1))
    assert s["f_statistic"] == pytest.approx(((sst - sse) / k) / (sse / (n - k - 1)))
    assert s["sigma"] == pytest.approx(math.sqrt(sse / (n - k - 1)))
    assert s["aic"] == pytest.approx(n * (math.log(2 * math.pi * sse / n) + 1) + 2 * (k + 2))


def test_score_keeps_unscorable_rows(frame, model):
    df = frame(
        [(0.0, "A2", " 60 months", 10.0, 5.0), (0.0, "Z9", " 36 months", 10.0, 5.0),
         (0.0, "A1", " 36 months", None, 5.0), (0.0, None, " 36 months", 10.0, 5.0)], SCHEMA,
    )
    scores = [r["prediction"] for r in models.score(model, df).collect()]
    assert scores[1:] == [None, None, None]
    assert scores[0] == pytest.approx(
        model.intercept + model.effects["sub_grade"]["A2"] + model.effects["term"][" 60 months"]
        + 10 * model.slopes["int_rate"] + 5 * model.slopes["dti"]
    )


def test_scoring_is_a_projection(train, model):
    plan = models.score(model, train)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_missing_values_are_left_out_of_the_fit(frame, model):
    extra = [(5.0, None, " 36 months", 10.0, 1.0), (5.0, "A1", " 36 months", None, 1.0), (None, "A1", " 36 months", 1.0, 1.0)]
    other = models.fit_ols(frame(ROWS + extra, SCHEMA), "y")
    assert other.intercept == pytest.approx(model.intercept)


def test_level_absent_from_training_gets_no_score(train):
    fitted = models.fit_ols(train.filter("sub_grade <> 'C1'"), "y")
    assert "C1" not in fitted.effects["sub_grade"]
    scored = models.score(fitted, train)
    assert scored.filter("(prediction is null) <> (sub_grade = 'C1')").count() == 0
    assert scored.filter("prediction is null").count() > 0
    assert all(c[2] is not None for c in fitted.coefficients)


def test_too_many_features_are_an_error(frame):
    rows = [(float(i), f"v{i}", 1.0) for i in range(30)]
    with pytest.raises(ValueError):
        models.category_levels(frame(rows, "y double, a string, x double"), ["a"], most=29)


def test_collinear_predictors_still_score(train):
    twice = train.withColumn("rate2", F.col("int_rate") * 2)
    fitted = models.fit_ols(twice, "y", ["term", "int_rate", "rate2"])
    single = models.fit_ols(twice, "y", ["term", "int_rate"])
    assert all(c[2] is None for c in fitted.coefficients)
    gap = twice.select(F.max(F.abs(fitted.prediction() - single.prediction()))).first()[0]
    assert gap < 1e-3


def test_numeric_predictors_only(train):
    fitted = models.fit_ols(train, "y", ["int_rate", "dti"])
    x = np.array([[1.0, r, d] for _, _, _, r, d in ROWS])
    beta, *_ = np.linalg.lstsq(x, np.array([r[0] for r in ROWS]), rcond=None)
    assert [fitted.intercept, *fitted.slopes.values()] == pytest.approx(list(beta))


def test_category_levels(frame):
    df = frame([("b", "x"), ("a", "x"), (None, "y")], "p string, q string")
    assert models.category_levels(df, ["p", "q"]) == {"p": ["a", "b"], "q": ["x", "y"]}
    with pytest.raises(ValueError):
        models.category_levels(df, ["p", "q"], most=3)


def test_confusion_has_four_cells(frame):
    df = frame([(1, 1), (1, 0), (1, 1), (None, 1)], "p int, a int")
    cells = {(r["predicted"], r["actual"]): r["count"] for r in models.confusion(df, "p", "a").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    assert models.accuracy(df, "p", "a").first()["accuracy"] == pytest.approx(2 / 3)


def test_error_metrics_differ(frame):
    df = frame([(1.0, 0.0), (0.0, 1.0), (3.0, 1.0)], "y double, p double")
    row = models.error_metrics(df, "y", "p").first()
    assert row["abs_mean_error"] == pytest.approx(2 / 3) and row["rmse"] == pytest.approx(math.sqrt(2))


def test_residual_trend(frame):
    df = frame([(float(i), float((-1) ** i * i)) for i in range(1, 101)] + [(None, 1.0)], "p double, e double")
    rows = models.residual_trend(df, "p", "e", bins=4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [24, 25, 25, 26]
    assert rows[0]["mean_abs_residual"] == pytest.approx(12.5) == rows[0]["mean_prediction"]


def leveled(frame, n=600, levels=150):
    rng = random.Random(9)
    rows = []
    for _ in range(n):
        g = min(rng.randrange(levels), rng.randrange(levels)) if rng.random() < 0.6 else 0
        t, r, d = rng.choice([" 36 months", " 60 months"]), rng.uniform(5, 25), rng.uniform(0, 40)
        y = g / 50 - 0.2 * (t == " 60 months") - 0.03 * r + rng.gauss(0, 0.1)
        rows.append((y, f"v{g:03d}", t, r, d))
    return rows, frame(rows, SCHEMA)


def test_absorbed_levels_give_the_same_fit(spark, frame):
    _, train = leveled(frame)
    whole, absorbed = models.fit(train, "y"), models.fit(train, "y", most=50)
    assert isinstance(whole, models.LinearModel) and isinstance(absorbed, models.AbsorbedModel)
    assert absorbed.level == "sub_grade" and absorbed.predictors == ["sub_grade", "int_rate", "dti", "term"]
    wanted = {r["term"]: r for r in models.coefficient_table(spark, whole).collect()}
    for r in absorbed.coefficients().collect():
        for c in ("estimate", "std_error", "t_value"):
            assert r[c] == pytest.approx(wanted[r["term"]][c], rel=1e-6)
    effects = as_dict(absorbed.level_effects(), "level", "effect")
    assert effects["v000"] == pytest.approx(wanted["(Intercept)"]["estimate"])
    assert effects["v007"] - effects["v000"] == pytest.approx(wanted["sub_gradev007"]["estimate"])
    stats = [models.fit_stats(m, train).first().asDict() for m in (whole, absorbed)]
    assert stats[0] == pytest.approx(stats[1], rel=1e-6)


def test_absorbed_scores_of_unseen_and_missing(frame):
    rows, train = leveled(frame)
    model = models.fit(train, "y", most=50)
    nan = float("nan")
    asked = [(0.0, "v000", " 60 months", 10.0, 1.0), (0.0, "new", " 60 months", 10.0, 1.0), (0.0, None, " 60 months", 10.0, 1.0),
             (0.0, "v000", None, 10.0, 1.0), (0.0, "v000", " 60 months", nan, 1.0)]
    scores = [r["prediction"] for r in models.score(model, frame(asked, SCHEMA)).orderBy(F.col("prediction").desc_nulls_last()).collect()]
    assert scores[0] is not None and scores[1:] == [None] * 4
    whole = models.fit(train, "y")
    left = sorted(r["prediction"] for r in models.score(model, train).collect())
    right = sorted(r["prediction"] for r in models.score(whole, train).collect())
    assert left == pytest.approx(right)


def test_absorbing_singletons_and_empty_training(frame):
    alone = frame([(float(i), f"v{i}", " 36 months", i / 2, 1.0) for i in range(60)], SCHEMA)
    model = models.fit(alone, "y", most=20)
    # every level explains its own row: nothing is left for the slopes
    assert set(model.slopes) == {0.0} and model.variance is None
    assert models.score(model, alone).filter("abs(prediction - y) < 1e-9").count() == 60
    from riskbook.operators.absorb import fit_absorbed
    empty = fit_absorbed(alone.limit(0), "y", "sub_grade", ["sub_grade", "int_rate"])
    assert models.score(empty, alone).filter("prediction is not null").count() == 0

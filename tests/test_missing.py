import math

import pytest

from conftest import as_dict
from riskbook.operators import associate, clean, missing, profile, segments

NAN = float("nan")
ROWS = [(1.0, 1, "a"), (NAN, 2, "a"), (None, 3, "b"), (4.0, None, None), (7.0, 5, "b")]


@pytest.fixture(scope="module")
def df(frame):
    return frame(ROWS, "x double, i int, t string")


def test_nan_becomes_null_and_other_columns_stay(df):
    out = missing.nan_to_null(df)
    assert out.schema == df.schema
    assert [r["x"] for r in out.collect()] == [1.0, None, None, 4.0, 7.0]
    whole = df.select("i", "t")
    assert missing.nan_to_null(whole) is whole


def test_counts_tell_null_from_nan(df):
    rows = {r["column"]: r for r in missing.missing_counts(df).collect()}
    assert (rows["x"]["n_null"], rows["x"]["n_nan"], rows["x"]["frac_missing"]) == (1, 1, 0.4)
    assert (rows["i"]["n_null"], rows["i"]["n_nan"]) == (1, 0) and rows["t"]["n_null"] == 1
    empty = missing.missing_counts(df.limit(0)).collect()
    assert {(r["n_null"], r["n_nan"], r["frac_missing"]) for r in empty} == {(0, 0, None)}


def test_names_with_special_signs(frame):
    odd = frame([(NAN, 1.0)], "`a.b` double, `c``d` double")
    assert missing.nan_to_null(odd).first()[0] is None
    assert as_dict(missing.missing_counts(odd), "column", "n_nan") == {"a.b": 1, "c`d": 0}


def test_profile_counts_nan_as_missing(df):
    nulls = as_dict(profile.null_profile(df), "column", "n_null")
    assert nulls == {"x": 2, "i": 1, "t": 1}
    assert as_dict(profile.distinct_counts(df, ["x"]), "column", "n_distinct") == {"x": 4}
    assert as_dict(profile.std_by_column(df, ["x"]), "column", "std") == {"x": None}
    lenient = as_dict(profile.std_by_column(df, ["x"], strict_nulls=False), "column", "std")["x"]
    assert lenient == pytest.approx(3.0)
    row = profile.range_of(df, ["x"]).first()
    assert (row["min"], row["max"], row["n_null"]) == (1.0, 7.0, 2)


def test_histogram_neither_crashes_on_nan_nor_counts_it(df, frame):
    assert sum(r["count"] for r in profile.histogram(df, "x").collect()) == 3
    given = profile.histogram(df, "x", [0.0, 5.0]).orderBy("bin").collect()
    assert [r["count"] for r in given] == [0, 2, 1]
    only = frame([(NAN,), (None,)], "x double")
    assert sum(r["count"] for r in profile.histogram(only, "x").collect()) == 0
    infinite = frame([(math.inf,), (-math.inf,), (1.0,), (2.0,)], "x double")
    bins = profile.histogram(infinite, "x").orderBy("bin").collect()
    assert sum(r["count"] for r in bins) == 4 and all(math.isfinite(r["lower"]) for r in bins)


def test_means_and_imputation_pass_nan_over(df):
    assert as_dict(clean.column_means(df, ["x"]), "column", "mean") == {"x": 4.0}
    assert [r["x"] for r in clean.impute_mean(df, ["x"]).collect()] == [1.0, 4.0, 4.0, 4.0, 7.0]
    assert [r["x"] for r in clean.fill_missing(df, {"x": None}).collect()] == [1.0, None, None, 4.0, 7.0]


def test_class_means_strict_and_lenient(frame):
    df = frame(
        [("Fully Paid", 1.0, 2.0), ("Fully Paid", NAN, 4.0), ("Default", 5.0, None), ("Other", 9.0, 9.0)],
        "loan_status string, x double, y double",
    )
    rows = {r["column"]: (r["mean_paid"], r["mean_default"]) for r in profile.class_means(df, ["x", "y"]).collect()}
    assert rows == {"x": (1.0, 5.0), "y": (3.0, None)}
    mixed = profile.class_means(df, ["x", "y"], strict_nulls=["x"]).collect()
    assert {r["column"]: r["mean_paid"] for r in mixed} == {"x": None, "y": 3.0}
    nobody = profile.class_means(df.limit(0), ["x"]).collect()
    assert [(r["mean_paid"], r["mean_default"]) for r in nobody] == [(None, None)]


def test_correlation_and_segment_means(frame):
    df = frame([("a", 1.0, 2.0), ("a", 2.0, 4.5), ("b", NAN, 1.0), ("b", 3.0, 6.0)], "k string, x double, y double")
    r = associate.pearson_pairs(df, [("x", "y")], strict_nulls=False).first()["r"]
    assert r is not None and 0.9 < r <= 1
    assert as_dict(segments.mean_by(df, "k", "x"), "k", "x") == {"a": 1.5, "b": None}
    assert as_dict(segments.mean_by(df, "k", "x", strict_nulls=False), "k", "x") == {"a": 1.5, "b": 3.0}

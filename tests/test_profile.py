import math
from decimal import Decimal

import numpy as np
import pytest

from conftest import as_dict
from riskbook.operators import profile


@pytest.fixture(scope="module")
def df(frame):
    return frame(
        [(1, 1.0, "a", "Fully Paid"), (2, 2.0, "b", "Fully Paid"), (3, None, "", "Default"),
         (4, 4.0, None, "Default"), (5, 10.0, "a", "Charged Off Paid")],
        "i int, d double, t string, loan_status string",
    )


def test_shape(df):
    rows = [tuple(r) for r in profile.profile_shape(df).collect()]
    assert rows == [(1, "i", "integer", 5), (2, "d", "numeric", 5), (3, "t", "character", 5),
                    (4, "loan_status", "character", 5)]


def test_preview_is_ordered(df):
    assert [r["i"] for r in profile.preview(df, "i", 2).collect()] == [1, 2]


def test_summary(df):
    rows = {r["column"]: tuple(r)[1:] for r in profile.summarize_columns(df).collect()}
    assert rows["i"] == (1.0, 2.0, 3.0, 3.0, 4.0, 5.0, 0)
    assert rows["d"] == (1.0, 1.75, 3.0, 4.25, 5.5, 10.0, 1)


def test_nulls(df):
    rows = {r["column"]: tuple(r)[1:] for r in profile.null_profile(df).collect()}
    assert rows["d"] == (1, 0.2, True) and rows["i"] == (0, 0.0, False)


def test_distinct(df, frame):
    expected = {"i": 5, "d": 5, "t": 4, "loan_status": 3}
    assert as_dict(profile.distinct_counts(df), "column", "n_distinct") == expected
    assert as_dict(profile.distinct_counts(df, approximate=True), "column", "n_distinct") == expected
    assert {r[0] for r in profile.distinct_values(df, "t").collect()} == {"a", "b", "", None}
    signed = frame([(0.0,), (-0.0,)], "z double")
    assert profile.distinct_counts(signed).first()["n_distinct"] == 1


def test_std_is_strict(df, frame):
    strict = as_dict(profile.std_by_column(df), "column", "std")
    assert strict["i"] == pytest.approx(np.std([1, 2, 3, 4, 5], ddof=1)) and strict["d"] is None
    lenient = as_dict(profile.std_by_column(df, strict_nulls=False), "column", "std")
    assert lenient["d"] == pytest.approx(np.std([1, 2, 4, 10], ddof=1))
    assert profile.std_by_column(frame([(1,)], "a int")).first()["std"] is None


def test_class_means_by_exact_label(df):
    lenient = {r["column"]: tuple(r)[1:] for r in profile.class_means(df, ["i", "d"]).collect()}
    assert lenient == {"i": (1.5, 3.5), "d": (1.5, 4.0)}
    strict = profile.class_means(df, ["i", "d"], strict_nulls=True).collect()
    assert {r["column"]: tuple(r)[1:] for r in strict} == {"i": (1.5, 3.5), "d": (1.5, None)}


def test_range(df):
    assert tuple(profile.range_of(df, ["d"]).first()) == ("d", 1.0, 10.0, 1)


def test_histogram_is_closed_on_the_right(frame):
    df = frame([(0.0,), (1.0,), (1.5,), (2.0,), (3.5,), (9.0,), (None,)], "x double")
    rows = profile.histogram(df, "x", [0, 1, 2, 3, 4]).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["count"]) for r in rows] == [
        (None, 0.0, 0), (0.0, 1.0, 2), (1.0, 2.0, 2), (2.0, 3.0, 0), (3.0, 4.0, 1), (4.0, None, 1),
    ]


def test_default_breaks_cover_every_value(frame):
    values = [math.sin(i) * 37 for i in range(200)]
    df = frame([(v,) for v in values], "x double")
    rows = profile.histogram(df, "x").orderBy("bin").collect()
    assert sum(r["count"] for r in rows) == 200
    steps = {round(r["upper"] - r["lower"], 9) for r in rows}
    assert steps == {10.0}


@pytest.mark.parametrize("low, high, n, expected", [
    (0, 10, 5, [0, 2, 4, 6, 8, 10]),
    (6.0, 24.0, 15, [float(v) for v in range(6, 25)]),
    (0.1, 0.9, 4, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]),
    (3, 3, 4, [2.5, 3.5]),
])
def test_pretty_breaks(low, high, n, expected):
    assert profile.pretty_breaks(low, high, n) == pytest.approx(expected)


def test_decimals_stay_apart_and_nan_is_missing(frame):
    rows = [(Decimal("1.000000000000000001"), 1.0), (Decimal("1.000000000000000002"), float("nan")), (Decimal(1), 5.0)]
    df = frame(rows, "d decimal(38,18), x double")
    assert {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df).collect()} == {"d": 3, "x": 3}
    row = profile.summarize_columns(df, ["x"]).first()
    assert (row["min"], row["mean"], row["max"], row["q3"], row["n_null"]) == (1.0, 3.0, 5.0, 4.0, 1)


def test_class_means_do_not_show_the_order_of_rows(frame):
    values = [1e9 + 0.1, 0.1, 0.2, 0.3] * 25
    found = set()
    for rows in (values, sorted(values), sorted(values, reverse=True)):
        df = frame([("Default", v) for v in rows] + [("Fully Paid", float("inf")), ("Fully Paid", None)],
                   "loan_status string, v double").coalesce(1)
        [row] = profile.class_means(df, ["v"]).collect()
        found.add(row["mean_default"])
        assert row["mean_paid"] == float("inf")
    assert len(found) == 1

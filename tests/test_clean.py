import pytest
from pyspark.sql import functions as F

from riskbook.operators import clean
from riskbook.schema import columns_of_type


def test_exclude_statuses_drops_missing(frame):
    df = frame([("Current",), ("Fully Paid",), (None,), ("Late (16-30 days)",)], "loan_status string")
    assert [r[0] for r in clean.exclude_statuses(df).collect()] == ["Fully Paid"]


def test_drop_columns_ignores_absent(frame):
    df = frame([(1, 2)], "a int, b int")
    assert clean.drop_columns(df, ["b", "zzz"]).columns == ["a"]


def test_columns_of_type(frame):
    df = frame([("x", 1, 1.0, True)], "t string, i int, d double, b boolean")
    assert columns_of_type(df, "numeric") == ["i", "d"]
    assert columns_of_type(df, "character") == ["t"]


SCREEN = "half int, over int, same string, blank string, onenull string, nulls string, num int, numnull int"


@pytest.fixture(scope="module")
def screened(frame):
    return frame(
        [
            (1, 1, "x", "", "x", None, 7, 7),
            (2, None, "x", "", None, None, 7, None),
            (None, None, "x", "", "x", None, 7, 7),
            (None, None, "x", "", "x", None, 7, 7),
        ],
        SCREEN,
    )


def test_sparse_is_strictly_over_the_limit(screened):
    assert {r["column"] for r in clean.sparse_columns(screened).collect()} == {"over", "nulls"}
    assert "half" in clean.drop_sparse_columns(screened).columns


def test_nothing_sparse_drops_nothing(frame):
    df = frame([(1,), (2,)], "a int")
    assert clean.drop_sparse_columns(df).columns == ["a"]


def test_constant_rules(screened):
    # Text: a missing value is a value. Numbers: a missing value hides constancy.
    found = {r["column"] for r in clean.constant_columns(screened).collect()}
    assert found == {"same", "blank", "nulls", "num"}
    assert clean.drop_constant_columns(screened).columns == ["half", "over", "onenull", "numnull"]


def test_single_row_numbers_are_not_constant(frame):
    df = frame([(1, "a")], "n int, t string")
    assert [r["column"] for r in clean.constant_columns(df).collect()] == ["t"]


def test_no_rows(frame):
    df = frame([], "n int, t string")
    assert clean.constant_columns(df).collect() == []
    assert clean.sparse_columns(df).collect() == []


def test_ratio_to(frame):
    rows = clean.ratio_to(frame([(6, 3), (1, 0)], "a int, f int"), ["a"], "f").collect()
    assert [r["a"] for r in rows] == [2.0, None]


def test_impute_mean_keeps_fractions_and_leaves_no_null(frame):
    df = frame([(1, None), (2, None), (None, None)], "a int, b double")
    out = clean.impute_mean(df, ["a", "b"])
    assert sorted(r["a"] for r in out.collect()) == [1.0, 1.5, 2.0]
    # Nothing to average: stays missing.
    assert out.filter(F.col("b").isNotNull()).count() == 0


def test_many_columns_in_batches(frame):
    names = [f"c{i}" for i in range(130)]
    df = frame([tuple(range(130)), tuple(range(1, 131))], ", ".join(f"{n} int" for n in names))
    means = {r["column"]: r["mean"] for r in clean.column_means(df, names).collect()}
    assert means == {n: i + 0.5 for i, n in enumerate(names)}


def test_screening_values_taken_once_say_what_the_statistics_say(frame):
    nan = float("nan")
    df = clean.nan_to_null(frame(
        [(1, "a", "x", None, 2.0, 5, nan, True), (2, "a", None, None, 2.0, None, nan, True),
         (3, "a", None, None, 2.0, 5, 1.0, True)],
        "id int, same string, gaps string, empty string, level double, holes int, some double, flag boolean",
    ))
    for rows in (df, df.filter("id = 1"), df.filter("id < 0")):
        metrics = clean.screen_metrics(rows, rows.columns)
        assert len(metrics) <= 3 * len(rows.columns) + 1
        seen = rows.selectExpr(*[f"{sql} as {label}" for label, sql in metrics.items()]).first().asDict()
        shares, constant = clean.screened(rows, rows.columns, seen)
        known = {r["column"]: r for r in clean.column_screen(rows).collect()}
        assert shares == {c: r["null_share"] for c, r in known.items()}
        assert constant == [c for c in rows.columns if known[c]["is_constant"]]

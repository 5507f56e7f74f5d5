import pytest
from pyspark.sql import functions as F

from riskbook.functions import columns as c


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_parse_percent(frame):
    df = frame([("13.5%",), (" 7%",), ("bad",), ("",), (None,), ("5d%",), ("1e1%",)], "t string")
    assert values(df, c.parse_percent(F.col("t"))) == [13.5, 7.0, None, None, None, None, 10.0]


def test_first_token(frame):
    df = frame([("Dec-2015",), ("Dec",), ("",), (None,)], "t string")
    assert values(df, c.first_token(F.col("t"))) == ["Dec", "Dec", "", None]


def test_outcome_keeps_paid_labels_and_nulls(frame):
    exception = "Does not meet the credit policy. Status:Fully Paid"
    df = frame([("Fully Paid",), (exception,), ("Charged Off",), ("",), (None,)], "s string")
    assert values(df, c.recode_outcome(F.col("s"))) == [
        "Fully Paid", exception, "Default", "Default", None,
    ]
    assert values(df, c.binary_target(F.col("s"))) == [1, 1, 0, 0, None]


def test_ratio_zero_and_null(frame):
    df = frame([(1, 2), (1, 0), (None, 2), (1, None)], "a int, b int")
    assert values(df, c.ratio(F.col("a"), F.col("b"))) == [0.5, None, None, None]


def test_recovery_rate_capped_above_only(frame):
    df = frame([(5.0, 4.0), (1.0, 4.0), (-1.0, 4.0), (None, 4.0), (1.0, 0.0)], "r double, f double")
    assert values(df, c.recovery_rate(F.col("r"), F.col("f"))) == [1.0, 0.25, -0.25, None, None]


def test_ccf_is_not_clipped(frame):
    df = frame([(4.0, 1.0), (4.0, 5.0), (4.0, None), (0.0, 0.0)], "f double, p double")
    assert values(df, c.ccf(F.col("f"), F.col("p"))) == [0.75, -0.25, None, None]


def test_classify_is_strict(frame):
    df = frame([(0.62,), (0.63,), (None,)], "p double")
    assert values(df, c.classify(F.col("p"), 0.62, above=0, below=1)) == [1, 0, None]


@pytest.mark.parametrize(
    "closed, expected", [("left", [0, 1, 1, 2, 2, None]), ("right", [0, 0, 1, 1, 2, None])]
)
def test_bin_index(frame, closed, expected):
    df = frame([(0.5,), (1.0,), (1.5,), (2.0,), (9.0,), (None,)], "x double")
    assert values(df, F.expr(c.bin_index_sql("x", [1.0, 2.0], closed))) == expected


def test_bin_index_without_cuts(frame):
    df = frame([(0.5,), (None,)], "x double")
    assert values(df, F.expr(c.bin_index_sql("x", []))) == [0, None]

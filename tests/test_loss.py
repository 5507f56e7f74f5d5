import pytest
from pyspark.sql import functions as F

from riskbook.operators import loss


def test_default_targets(frame):
    df = frame(
        [(0, 5.0, 4.0, 1.0), (0, 1.0, 4.0, 5.0), (1, 1.0, 4.0, 1.0), (0, None, 4.0, 1.0), (None, 1.0, 4.0, 1.0)],
        "loan_status int, recoveries double, funded_amnt double, total_rec_prncp double",
    )
    rows = [(r["recovery_rate"], r["ccf"]) for r in loss.default_targets(df).collect()]
    assert rows == [(1.0, 0.75), (0.25, -0.25), (None, 0.75)]


@pytest.fixture(scope="module")
def scored(frame):
    df = frame(
        [(0.7, 0.2, 0.5, 100.0), (0.62, 0.2, 0.5, 100.0), (0.1, 1.2, 0.5, 200.0), (None, 0.2, 0.5, 50.0)],
        "p double, r double, c double, funded_amnt double",
    )
    return loss.expected_loss(df, F.col("p"), F.col("r"), F.col("c"))


def test_expected_loss(scored):
    rows = [(r["PD"], r["LGD"], r["EAD"], r["EL"]) for r in scored.collect()]
    assert [r[0] for r in rows] == [0, 1, 1, None]
    assert [r[3] for r in rows[:3]] == pytest.approx([0.0, 40.0, -20.0]) and rows[3][3] is None
    # Neither part is clipped.
    assert rows[2][1] == pytest.approx(-0.2)


def test_totals(scored):
    strict = loss.portfolio_loss(scored).first()
    assert (strict["total_el"], strict["el_share"]) == (None, None)
    assert (strict["n_loans"], strict["n_unscored"]) == (4, 1)
    loose = loss.portfolio_loss(scored, strict_nulls=False).first()
    assert loose["total_el"] == pytest.approx(20.0) and loose["el_share"] == pytest.approx(20 / 450)
    known = loss.portfolio_loss(scored.filter("EL is not null")).first()
    assert known["total_el"] == pytest.approx(20.0) and known["el_share"] == pytest.approx(20 / 400)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_totals_have_the_same_bits_under_any_partitions(spark, scale):
    amount = (F.sin(F.col("id")) * scale + 0.1)
    scored = spark.range(20_000).select(amount.alias("EL"), F.abs(amount).alias("funded_amnt"))
    rows = {tuple(loss.portfolio_loss(scored.repartition(n)).first()) for n in (1, 7, 200)}
    assert len(rows) == 1
    assert rows.pop()[0] == pytest.approx(sum(r["EL"] for r in scored.collect()), abs=1e-6 * scale)


def test_amounts_without_a_sum_void_the_totals(frame):
    nan, inf = float("nan"), float("inf")
    df = frame([(1.5, 2.0), (inf, 1.0)], "EL double, funded_amnt double")
    assert loss.portfolio_loss(df).first()["total_el"] is None
    unscored = frame([(1.5, 2.0), (nan, 1.0)], "EL double, funded_amnt double")
    row = loss.portfolio_loss(unscored, strict_nulls=False).first()
    assert (row["total_el"], row["el_share"], row["n_unscored"]) == (1.5, 0.5, 1)
    empty = loss.portfolio_loss(df.limit(0)).first()
    assert (empty["total_el"], empty["n_loans"]) == (None, 0)

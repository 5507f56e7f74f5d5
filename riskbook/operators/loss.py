"""Recovery and exposure targets, expected loss and portfolio totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.aggregates import null_count, strict
from riskbook.functions.columns import ccf, classify, recovery_rate, recovery_share
from riskbook.operators.missing import nan_to_null
from riskbook.schema import SCORE_CUT

# Amounts as the totals add them.
AMOUNT = "decimal(28,8)"


def default_targets(df: DataFrame, target: str = "loan_status") -> DataFrame:
    """The defaulted loans (target 0) with recovery_rate, ccf and the uncapped recovery_share."""
    return df.filter(F.col(target) == 0).withColumns(
        {
            "recovery_rate": recovery_rate(F.col("recoveries"), F.col("funded_amnt")),
            "recovery_share": recovery_share(F.col("recoveries"), F.col("funded_amnt")),
            "ccf": ccf(F.col("funded_amnt"), F.col("total_rec_prncp")),
        }
    )


def expected_loss(
    df: DataFrame,
    p_paid: Column,
    recovery: Column,
    conversion: Column,
    threshold: float = SCORE_CUT,
) -> DataFrame:
    """Adds p_paid, recovery_rate, ccf, LGD, EAD, PD and EL to every loan.

    PD is 0 for a score above the threshold and 1 otherwise, not a
    probability. Recovery and conversion are not clipped, so LGD may leave
    [0, 1] and EAD the funded amount. A loan without a score keeps NULLs.
    """
    scored = df.withColumns(
        {"p_paid": p_paid, "recovery_rate": recovery, "ccf": conversion}
    ).withColumns(
        {
            "LGD": 1 - F.col("recovery_rate"),
            "EAD": F.col("ccf") * F.col("funded_amnt"),
            "PD": classify(F.col("p_paid"), threshold, above=0, below=1),
        }
    )
    return scored.withColumn("EL", F.col("PD") * F.col("LGD") * F.col("EAD"))


def exact_sum(amount: Column) -> Column:
    """The sum of amounts rounded to AMOUNT's places, as double.

    Decimal partial sums are exact, so the bits don't hang on the order of the
    rows or on their partitions, as they do with doubles. An infinite amount,
    or one of 10^20 and more, voids the sum.
    """
    places = amount.cast("double").try_cast(AMOUNT)
    lost = F.count(amount) > F.count(places)
    return F.when(~lost, F.sum(places).cast("double"))


def portfolio_loss(scored: DataFrame, strict_nulls: bool = True) -> DataFrame:
    """(total_el, el_share, n_loans, n_unscored).

    Strictly, one loan without a score voids the totals; otherwise they cover
    the scored loans, and their share the amount of all. The sums are exact to
    eight places a loan: the same bits whatever the partitions.
    """
    scored = nan_to_null(scored)
    el, funded = F.col("EL"), F.col("funded_amnt")
    total = strict(exact_sum(el), el) if strict_nulls else exact_sum(el)
    base = strict(exact_sum(funded), funded) if strict_nulls else exact_sum(funded)
    return scored.agg(
        total.alias("total_el"),
        F.try_divide(total, base).alias("el_share"),
        F.count(F.lit(1)).alias("n_loans"),
        null_count(el).alias("n_unscored"),
    )

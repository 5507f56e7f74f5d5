"""Row-level expressions. A missing input gives a missing output throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskbook.functions.text import double_literal, quoted
from riskbook.schema import DEFAULT_LABEL, PAID_MARK, RECOVERY_CAP


# The JVM also reads a trailing type letter ("5d", "5f") as a number, which no
# loan file means, so such text is refused. The text NaN is a missing number.
NUMBER_SQL = (
    r"case when not regexp_like({text}, '[0-9.][dDfF]\\s*$')"
    " then nullif(try_cast({text} as double), double('NaN')) end"
)


def number_from_text(text: Column) -> Column:
    """Number in the text, or NULL when it is not one (or not a number by name)."""
    number = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), number)


def parse_percent(text: Column) -> Column:
    """Number in text such as "13.5%"."""
    return number_from_text(F.replace(text, F.lit("%"), F.lit("")))


def first_token(text: Column, separator: str = "-") -> Column:
    """Text before the first separator, e.g. the month of "Dec-2015"."""
    return F.substring_index(text, separator, 1)


def recode_outcome(status: Column) -> Column:
    """Keep a status that mentions the paid mark, call every other one a default."""
    return F.when(status.contains(PAID_MARK), status).when(
        status.isNotNull(), F.lit(DEFAULT_LABEL)
    )


def binary_target(status: Column) -> Column:
    """1 for a paid loan, 0 for a defaulted one."""
    return status.contains(PAID_MARK).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def recovery_share(recoveries: Column, funded: Column) -> Column:
    """Recovered share of the funded amount as it is."""
    return ratio(recoveries, funded)


def recovery_rate(recoveries: Column, funded: Column) -> Column:
    """Recovered share of the funded amount, capped above but not below."""
    share = recovery_share(recoveries, funded)
    return F.when(share > RECOVERY_CAP, F.lit(RECOVERY_CAP)).otherwise(share)


def ccf(funded: Column, repaid_principal: Column) -> Column:
    """Credit conversion factor: unpaid share of the funded amount, unclipped."""
    return ratio(funded - repaid_principal, funded)


def classify(score: Column, threshold: float, above: int, below: int) -> Column:
    """One class strictly above the threshold, the other one at or under it."""
    return F.when(score > threshold, F.lit(above)).when(score.isNotNull(), F.lit(below))


def bin_index_sql(column: str, cuts: list[float], closed: str = "left") -> str:
    """SQL for how many ascending cuts the column has passed; NULL stays NULL.

    closed="left" counts a cut equal to the value as passed, "right" does not.
    """
    value = f"double({quoted(column)})"
    passed = ">=" if closed == "left" else ">"
    steps = [f"int({value} {passed} {double_literal(c)})" for c in cuts]
    return f"case when {value} is not null then {' + '.join(steps or ['0'])} end"

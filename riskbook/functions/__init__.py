from riskbook.functions.aggregates import null_count, pearson, strict
from riskbook.functions.columns import (
    bin_index_sql,
    binary_target,
    ccf,
    classify,
    first_token,
    number_from_text,
    parse_percent,
    ratio,
    recode_outcome,
    recovery_rate,
)

__all__ = [
    "bin_index_sql", "binary_target", "ccf", "classify", "first_token",
    "null_count", "number_from_text", "parse_percent", "pearson", "ratio",
    "recode_outcome", "recovery_rate", "strict",
]

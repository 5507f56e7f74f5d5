"""Column vocabulary and presets of the loan table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, labels and constants that decide the results.
# ---------------------------------------------------------------------------

EXCLUDED_STATUSES = ["In Grace Period", "Late (16-30 days)", "Current"]
PAID_MARK = "Paid"
PAID_LABEL = "Fully Paid"
DEFAULT_LABEL = "Default"

MAX_NULL_SHARE = 0.5
# A pair of columns this much correlated is a strong one.
MIN_ABS_R = 0.3
TRAIN_RATIO = "0.7"
SPLIT_SEED = 42
SCORE_CUT = 0.62
RECOVERY_CAP = 1.0
PREDICTORS = ["sub_grade", "int_rate", "dti", "term"]
# What the expected loss needs of a loan besides the predictors.
LOSS_INPUTS = ["funded_amnt", "recoveries", "total_rec_prncp"]

TEXT_COLUMNS = [
    "loan_status", "grade", "sub_grade", "term", "issue_d", "purpose", "title",
    "desc", "addr_state", "home_ownership", "verification_status",
    "verification_status_joint", "emp_length", "emp_title",
    "initial_list_status", "application_type", "pymnt_plan",
    "debt_settlement_flag", "debt_settlement_flag_date",
    "disbursement_method", "earliest_cr_line", "hardship_end_date",
    "hardship_flag", "hardship_loan_status", "hardship_reason",
    "hardship_start_date", "hardship_status", "hardship_type",
    "last_credit_pull_d", "last_pymnt_d", "next_pymnt_d",
    "payment_plan_start_date", "settlement_date", "settlement_status", "url",
    "zip_code",
]
PERCENT_COLUMNS = ["int_rate", "revol_util"]
KEY_COLUMNS = ["id", "member_id"]
NUMERIC_COLUMNS = [
    "acc_now_delinq", "acc_open_past_24mths", "all_util", "annual_inc",
    "avg_cur_bal", "bc_open_to_buy", "bc_util", "chargeoff_within_12_mths",
    "collection_recovery_fee", "collections_12_mths_ex_med", "delinq_2yrs",
    "delinq_amnt", "dti", "funded_amnt", "funded_amnt_inv", "il_util",
    "inq_fi", "inq_last_12m", "inq_last_6mths", "installment",
    "last_pymnt_amnt", "loan_amnt", "max_bal_bc", "mo_sin_old_il_acct",
    "mo_sin_old_rev_tl_op", "mo_sin_rcnt_rev_tl_op", "mo_sin_rcnt_tl",
    "mort_acc", "mths_since_last_delinq", "mths_since_rcnt_il",
    "mths_since_recent_bc", "mths_since_recent_inq", "num_accts_ever_120_pd",
    "num_actv_bc_tl", "num_actv_rev_tl", "num_bc_sats", "num_bc_tl",
    "num_il_tl", "num_op_rev_tl", "num_rev_accts", "num_rev_tl_bal_gt_0",
    "num_sats", "num_tl_120dpd_2m", "num_tl_30dpd", "num_tl_90g_dpd_24m",
    "num_tl_op_past_12m", "open_acc", "open_acc_6m", "open_act_il",
    "open_il_12m", "open_il_24m", "open_rv_12m", "open_rv_24m", "out_prncp",
    "out_prncp_inv", "pct_tl_nvr_dlq", "percent_bc_gt_75", "pub_rec",
    "pub_rec_bankruptcies", "recoveries", "revol_bal", "tax_liens",
    "tot_coll_amt", "tot_cur_bal", "tot_hi_cred_lim", "total_acc",
    "total_bal_ex_mort", "total_bal_il", "total_bc_limit", "total_cu_tl",
    "total_il_high_credit_limit", "total_pymnt", "total_pymnt_inv",
    "total_rec_int", "total_rec_late_fee", "total_rec_prncp",
    "total_rev_hi_lim",
]

# Removed unread before profiling.
DROP_UNUSED = [
    "collection_recovery_fee", "emp_title", "funded_amnt_inv", "id",
    "installment", "last_credit_pull_d", "last_pymnt_amnt", "last_pymnt_d",
    "loan_amnt", "member_id", "next_pymnt_d", "num_tl_120dpd_2m",
    "num_tl_30dpd", "out_prncp", "out_prncp_inv", "total_pymnt",
    "total_pymnt_inv", "total_rec_int", "total_rec_late_fee", "url",
    "zip_code",
]
# Removed on sight. One name is misspelt in the preset ("dept_..."), so the
# debt_settlement_flag column lives on until DROP_REVIEWED.
DROP_OBSERVED = [
    "hardship_flag", "hardship_type", "hardship_reason", "hardship_status",
    "hardship_start_date", "hardship_end_date", "payment_plan_start_date",
    "hardship_loan_status", "disbursement_method", "dept_settlement_flag",
    "debt_settlement_flag_date", "settlement_status", "settlement_date",
    "earliest_cr_line",
]
# Removed one by one after a look at each. num_il_tl and tot_hi_cred_lim stay.
DROP_REVIEWED = [
    "grade", "issue_m", "issue_d", "title", "desc",
    "verification_status_joint", "pymnt_plan", "mths_since_last_delinq",
    "open_acc", "total_acc", "application_type", "acc_now_delinq", "il_util",
    "open_act_il", "open_il_24m", "total_bal_il", "open_rv_24m", "all_util",
    "total_cu_tl", "mo_sin_old_il_acct", "mo_sin_old_rev_tl_op",
    "num_accts_ever_120_pd", "num_actv_bc_tl", "num_bc_sats", "num_bc_tl",
    "num_op_rev_tl", "num_rev_accts", "num_sats", "pct_tl_nvr_dlq",
    "total_bal_ex_mort", "total_il_high_credit_limit",
    "debt_settlement_flag", "revol_util", "num_rev_tl_bal_gt_0",
]

RATIO_COLUMNS = ["annual_inc", "revol_bal", "avg_cur_bal", "bc_open_to_buy"]
RATIO_DENOMINATOR = "funded_amnt"

IMPUTED_COLUMNS = [
    "dti", "inq_last_6mths", "open_acc_6m", "open_il_12m",
    "mths_since_rcnt_il", "open_rv_12m", "open_rv_24m", "max_bal_bc",
    "inq_fi", "inq_last_12m", "bc_open_to_buy", "bc_util",
    "mths_since_recent_bc", "mths_since_recent_inq", "percent_bc_gt_75",
    "tax_liens",
]

# Segments with a default rate as a fraction; the grade report is in percent.
SEGMENT_KEYS = [
    "addr_state", "pymnt_plan", "term", "home_ownership",
    "verification_status", "initial_list_status", "application_type",
    "acc_now_delinq", "debt_settlement_flag",
]
FREQUENCY_COLUMNS = [
    "purpose", "title", "home_ownership", "pymnt_plan", "term", "emp_length",
    "loan_status", "addr_state", "delinq_2yrs", "inq_last_6mths",
]

# Means by outcome: any missing value voids the strict ones.
STRICT_CLASS_MEANS = ["int_rate", "annual_inc"]
CLASS_MEANS = [
    "dti", "inq_last_6mths", "mths_since_last_delinq", "open_acc", "pub_rec",
    "revol_bal", "revol_util", "total_acc", "tot_coll_amt", "tot_cur_bal",
    "il_util", "open_acc_6m", "open_act_il", "open_il_12m", "open_il_24m",
    "mths_since_rcnt_il", "total_bal_il", "open_rv_12m", "open_rv_24m",
    "max_bal_bc", "all_util", "total_rev_hi_lim", "inq_fi", "total_cu_tl",
    "acc_open_past_24mths", "avg_cur_bal", "bc_open_to_buy", "bc_util",
    "chargeoff_within_12_mths", "delinq_amnt", "mo_sin_old_il_acct",
    "mo_sin_old_rev_tl_op", "mo_sin_rcnt_rev_tl_op", "mo_sin_rcnt_tl",
    "mort_acc", "mths_since_recent_bc", "mths_since_recent_inq",
    "num_accts_ever_120_pd", "num_actv_bc_tl", "num_actv_rev_tl",
    "num_bc_sats", "num_bc_tl", "num_il_tl", "num_op_rev_tl",
    "num_rev_accts", "num_rev_tl_bal_gt_0", "num_sats", "num_tl_90g_dpd_24m",
    "num_tl_op_past_12m", "pct_tl_nvr_dlq", "percent_bc_gt_75",
    "pub_rec_bankruptcies", "tax_liens", "tot_hi_cred_lim",
    "total_bal_ex_mort", "total_bc_limit", "total_il_high_credit_limit",
]

CORRELATION_PAIRS = [
    ("open_rv_12m", "open_rv_24m"),
    ("inq_last_12m", "inq_last_6mths"),
    ("inq_fi", "inq_last_6mths"),
    ("inq_last_12m", "inq_fi"),
    ("acc_open_past_24mths", "open_acc_6m"),
    ("mths_since_rcnt_il", "mo_sin_rcnt_rev_tl_op"),
    ("mo_sin_rcnt_tl", "mo_sin_rcnt_rev_tl_op"),
    ("revol_util", "int_rate"),
    ("tot_hi_cred_lim", "tot_cur_bal"),
]

# ---------------------------------------------------------------------------

_KINDS = {
    "character": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "numeric": (T.FloatType, T.DoubleType, T.DecimalType),
}


def kind_of(data_type: T.DataType) -> str:
    """character, integer, numeric, or the Spark name of any other type."""
    for kind, types in _KINDS.items():
        if isinstance(data_type, types):
            return kind
    return data_type.simpleString()


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Names of the character columns, or of the numeric ones (whole numbers included)."""
    wanted = {"numeric": {"numeric", "integer"}}.get(kind, {kind})
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in wanted]


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The names that the table has, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]

from riskbook.sources.loans import malformed_lines, read_loans, write_scored
from riskbook.sources.loan_view import loan_view, loan_view_sql
from riskbook.sources.staging import checkpoint_folder, run_folder, stage, stage_observed

__all__ = [
    "checkpoint_folder", "loan_view", "loan_view_sql", "malformed_lines", "read_loans", "run_folder", "stage",
    "stage_observed", "write_scored",
]

import duckdb
import pytest

import __spark_entry__ as entry
from riskbook.plans.oracles import all_oracles
from riskbook.plans.queries import all_queries
from tools.check_queries import compare, connect

# One query per family; tools/check_queries.py runs all of them.
CHECKED = [
    "default_rate_by_grade", "default_rate_by_acc_now_delinq", "segment_report",
    "null_safe_left_join", "class_means", "null_profile", "constant_columns", "prepared_loans",
    "corr_pairs", "corr_matrix", "woe_dti", "stratified_split", "recovery_split", "ccf_split",
    "residual_trend_fixed_score", "expected_loss_fixed_score", "pd_coefficients",
    "portfolio_loss_fixed_score", "woe_many_levels", "many_strata_split", "quantiles_by_brackets",
    "scores_of_unseen_level", "target_ranges", "shape", "lgd_p_values",
    "pruned_columns", "prepared_pruned_columns", "sketched_quantile_ranks", "sketched_distinct_within", "inferred_types",
    "typed_unknown_columns", "quarantined_lines", "distinct_values_desc", "many_level_slopes", "many_level_scores",
    "nan_null_profile", "nan_class_means", "nan_histogram_dti_default_breaks", "nan_prepared_loans", "nan_missing_counts",
]


def test_every_query_has_a_check():
    assert set(all_oracles()) == set(all_queries())
    assert set(all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    connection: duckdb.DuckDBPyConnection = connect(sf_dir)
    left = entry.queries()[name](spark, sf_dir).toPandas()
    right = connection.execute(entry.oracle_sql()[name]).df()
    assert len(left) > 0
    assert compare(left, right).startswith("ok")


def test_entry(spark):
    row = entry.entry(spark).first()
    # The small table has sub-grades without a training default: their loans have no score.
    assert 0 < row["n_unscored"] < row["n_loans"] and row["total_el"] is None

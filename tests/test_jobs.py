import pytest
from pyspark.sql import functions as F

from riskbook import schema
from riskbook.operators import loss
from riskbook.plans import jobs
from riskbook.sources import loan_view, stage


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return stage(loan_view(spark, sf_dir), "raw")


@pytest.fixture(scope="module")
def prepared(raw):
    return jobs.prepare_loans(raw)


def test_presets_are_consistent():
    known = set(
        schema.TEXT_COLUMNS + schema.PERCENT_COLUMNS + schema.KEY_COLUMNS + schema.NUMERIC_COLUMNS
    )
    assert len(known) == 117
    misspelt = {"dept_settlement_flag"}
    derived = {"issue_m"}
    drops = schema.DROP_UNUSED + schema.DROP_OBSERVED + schema.DROP_REVIEWED
    assert len(drops) == len(set(drops)) and set(drops) - known == misspelt | derived
    assert len(schema.DROP_UNUSED) == 21 and len(schema.DROP_OBSERVED) == 14
    assert len(schema.IMPUTED_COLUMNS) == 16 and set(schema.IMPUTED_COLUMNS) <= known
    assert len(schema.CLASS_MEANS) + len(schema.STRICT_CLASS_MEANS) == 59
    assert set(schema.CLASS_MEANS) <= known and len(schema.CORRELATION_PAIRS) == 9


def test_prepared_columns(prepared):
    columns = set(prepared.loans.columns)
    assert prepared.dropped_sparse == ["mths_since_last_record"]
    assert set(prepared.dropped_constant) == {
        "application_type", "policy_code", "verification_status_joint",
    }
    gone = set(schema.DROP_UNUSED + schema.DROP_OBSERVED + schema.DROP_REVIEWED) - {"id"}
    assert not columns & gone
    assert {"id", "num_il_tl", "tot_hi_cred_lim", "loan_status", *schema.PREDICTORS} <= columns


def test_no_nulls_left_where_imputed(prepared):
    names = [c for c in schema.IMPUTED_COLUMNS if c in prepared.loans.columns]
    assert len(names) == 15  # one of the sixteen is dropped afterwards
    assert prepared.loans.select(*names).na.drop().count() == prepared.loans.count()


def test_target_is_binary(prepared):
    assert {r[0] for r in prepared.loans.select("loan_status").distinct().collect()} == {0, 1}


def test_profile_tables(raw):
    report = jobs.portfolio_profile(raw)
    assert {"shape", "summary", "nulls", "distinct", "std", "class_means"} <= set(report)
    assert report["class_means"].count() == 59
    assert report["frequency_purpose"].count() == 5


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, found


def test_tables_that_nobody_asks_for_cost_no_job(spark, raw, prepared):
    report, n = jobs_of(spark, "profile", lambda: jobs.portfolio_profile(raw))
    assert n == 0 and len(report) == len(list(report)) > 10
    _, n = jobs_of(spark, "frequency", lambda: report["frequency_purpose"].collect())
    assert n <= 3
    assert report["nulls"] is report["nulls"]
    screening, n = jobs_of(spark, "screen", lambda: jobs.screen_features(prepared.loans))
    assert n == 0
    _, n = jobs_of(spark, "pairs", lambda: screening.pairs.collect())
    assert n <= 2


def test_preparing_takes_its_statistics_while_staging(spark, sf_dir):
    loans, n = jobs_of(spark, "prepare", lambda: jobs.prepare_loans(loan_view(spark, sf_dir)).loans.collect())
    assert n <= 6 and len(loans) == jobs.resolve(loan_view(spark, sf_dir)).count()


def test_an_empty_table_is_prepared(spark, sf_dir):
    empty = jobs.prepare_loans(loan_view(spark, sf_dir).filter("id < 0"))
    assert empty.loans.count() == 0 and set(empty.means.values()) == {None}
    assert empty.dropped_sparse == [] and empty.dropped_constant == []


def test_profile_shows_samples_and_missing_values(raw):
    report = jobs.portfolio_profile(raw)
    shape = {r["column"]: r["sample"] for r in report["shape"].collect()}
    first = jobs.resolve(raw).orderBy("id").limit(4).collect()
    assert shape["id"] == ", ".join(str(r["id"]) for r in first)
    assert shape["term"] == ", ".join(f'"{r["term"]}"' for r in first)
    assert report["missing"].count() == len(raw.columns)


def test_pruned_features_can_be_dropped(raw, prepared):
    drop = jobs.pruned_features(raw)
    gone = set(drop) - set(schema.DROP_REVIEWED)
    assert gone and not gone & set(schema.PREDICTORS + schema.LOSS_INPUTS)
    left = jobs.prepare_loans(raw, drop=drop)
    assert set(prepared.loans.columns) - set(left.loans.columns) == gone
    screening = jobs.screen_features(left.loans)
    assert screening.pruned().count() == 0


def test_segment_report(raw):
    report = jobs.segment_risk_report(raw)
    n = jobs.resolve(raw).count()
    assert sum(r["count"] for r in report["by_grade"].collect()) == n
    totals = report["by_segment"].groupBy("segment").sum("count").collect()
    assert {r["sum(count)"] for r in totals} == {n} and len(totals) == len(schema.SEGMENT_KEYS)
    assert report["issue_months"].count() <= 12


def test_screening(prepared):
    screening = jobs.screen_features(prepared.loans)
    iv = {r["variable"]: r["iv"] for r in screening.information_value.collect()}
    assert all(v >= -1e-12 for v in iv.values()) and iv["int_rate"] > iv["home_ownership"]
    # Two pairs involve a column that is dropped after the look at them.
    assert screening.pairs.count() == 7


def test_whole_run(prepared):
    loans = stage(prepared.loans, "prepared")
    trained = jobs.train_models(loans)
    assert trained.pd_rows.count() == loans.count()
    assert trained.pd.intercept != 0
    cells = jobs.evaluate_pd(trained)["confusion"].collect()
    assert sum(r["count"] for r in cells) == trained.pd_rows.filter("not is_train").count()
    parts = jobs.evaluate_ols(trained.lgd, trained.lgd_rows.filter("is_train"))
    # Least squares with an intercept leaves no mean error on its training rows.
    assert parts["errors"].first()["abs_mean_error"] < 1e-6
    n = trained.lgd_rows.filter("is_train").count()
    assert sum(r["count"] for r in parts["histogram"].collect()) == n
    assert sum(r["n"] for r in parts["trend"].collect()) == n
    scored, totals = jobs.expected_loss_run(loans)
    row = totals.first()
    assert row["n_loans"] == scored.count() == loans.count()
    # Sub-grades without a training default have no score.
    unseen = ~F.col("sub_grade").isin(*trained.lgd.effects["sub_grade"])
    assert row["n_unscored"] == scored.filter(unseen).count() == scored.filter("EL is null").count()
    assert 0 < loss.portfolio_loss(scored, strict_nulls=False).first()["el_share"] < 1

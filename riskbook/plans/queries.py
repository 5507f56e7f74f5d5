"""Named queries over the loan view, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.functions.columns import (
    binary_target,
    ccf,
    classify,
    first_token,
    parse_percent,
    recode_outcome,
    recovery_rate,
)
from riskbook.operators import (
    associate,
    clean,
    loss,
    missing,
    models,
    profile,
    segments,
    sketches,
    split,
)
from riskbook.operators.quantiles import interpolated_quantiles
from riskbook.plans import jobs
from riskbook.schema import (
    CLASS_MEANS,
    CORRELATION_PAIRS,
    DEFAULT_LABEL,
    DROP_OBSERVED,
    DROP_REVIEWED,
    DROP_UNUSED,
    FREQUENCY_COLUMNS,
    IMPUTED_COLUMNS,
    MIN_ABS_R,
    PREDICTORS,
    RATIO_COLUMNS,
    RATIO_DENOMINATOR,
    SEGMENT_KEYS,
    STRICT_CLASS_MEANS,
    columns_of_type,
)
from riskbook.sources import loan_view as plain_loan_view
from riskbook.sources import malformed_lines, read_loans, stage, write_scored
from riskbook.sources.staging import new_path
from riskbook.sources.types import infer_types

Query = Callable[[SparkSession, str], DataFrame]

# A model with given coefficients, so that scoring can be checked by itself.
FIXED_PD = models.LinearModel(
    target="loan_status",
    intercept=1.0,
    slopes={"int_rate": -0.03, "dti": -0.002},
    effects={"term": {" 36 months": 0.0, " 60 months": -0.05}},
)
FIXED_RECOVERY = models.LinearModel("recovery_rate", 0.05, {"int_rate": 0.01, "dti": 0.001})
FIXED_CCF = models.LinearModel("ccf", 0.4, {"int_rate": 0.002, "dti": 0.005})

# Columns of the loan view that get a NaN in every so manieth loan, for the queries named nan_*.
NAN_EVERY = {
    "dti": 31, "annual_inc": 29, "avg_cur_bal": 23, "bc_open_to_buy": 41, "acc_now_delinq": 47,
    "recoveries": 53, "total_rec_prncp": 43, "inq_last_6mths": 37, "open_rv_24m": 59,
}
_PLANTED: ContextVar[bool] = ContextVar("planted", default=False)

DTI_BREAKS = [float(b) for b in range(0, 36, 5)]
RATE_BREAKS = [float(b) for b in range(6, 26, 2)]
RESIDUAL_BREAKS = [b / 10 for b in range(-10, 11, 2)]
UNSEEN_LEVEL = "G5"


def loan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan view, with NaN planted in it where a query asks for that."""
    loans = plain_loan_view(spark, sf_dir)
    if not _PLANTED.get():
        return loans
    planted = {
        c: F.when(F.col("id") % n == 0, F.lit(float("nan"))).otherwise(F.col(c).cast("double"))
        for c, n in NAN_EVERY.items()
    }
    return loans.withColumns(planted)


def with_nan(query: Query) -> Query:
    """The same query over the view with NaN planted in it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _PLANTED.set(True)
        try:
            return query(spark, sf_dir)
        finally:
            _PLANTED.reset(token)

    return run


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, since summation order differs between engines."""
    return df.select(
        *[
            F.round(f.name, other.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.resolve(loan_view(spark, sf_dir))


def _targeted(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    """Resolved loans with the 0/1 target and the mean-imputed predictor dti."""
    book = _book(spark, sf_dir).select(
        "id", "loan_status", *PREDICTORS, "funded_amnt", "recoveries", "total_rec_prncp"
    )
    if staged:
        book = stage(book, "book")
    return clean.impute_mean(book, ["dti"]).withColumn(
        "loan_status", binary_target(F.col("loan_status"))
    )


def _trained(spark: SparkSession, sf_dir: str, *wanted: str, without: Column | None = None) -> jobs.Trained:
    """The wanted models, fitted on the shortest table that has what they need."""
    return jobs.train_models(_targeted(spark, sf_dir, staged=True), wanted=wanted, without=without)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table of the view, over the table that its preparation stages."""
    return jobs.prepare_loans(loan_view(spark, sf_dir)).loans


def _staged_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved book, staged: the joins behind the view run once, not once a pass."""
    return stage(_book(spark, sf_dir), "book")


def _fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with p_paid and residual of the fixed model, and its class."""
    scored = models.with_residual(
        models.score(FIXED_PD, _targeted(spark, sf_dir), "p_paid"), "loan_status", "p_paid"
    )
    return scored.withColumn("predicted", classify(F.col("p_paid"), 0.62, above=1, below=0))


def _fixed_loss(spark: SparkSession, sf_dir: str, impute: bool = True) -> DataFrame:
    book = _targeted(spark, sf_dir) if impute else _book(spark, sf_dir)
    return loss.expected_loss(
        book, FIXED_PD.prediction(), FIXED_RECOVERY.prediction(), FIXED_CCF.prediction()
    )


# -- segments ---------------------------------------------------------------


def _segment_rate(key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        book = jobs.with_issue_month(_book(spark, sf_dir))
        return rounded(segments.segment_default_rate(book, key))

    return run


def default_rate_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.grade_report(_book(spark, sf_dir)))


def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.segment_report(_book(spark, sf_dir), SEGMENT_KEYS))


def status_counts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.count_by(clean.exclude_statuses(loan_view(spark, sf_dir)), "loan_status")


def status_counts_recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.count_by(_book(spark, sf_dir), "loan_status")


def issue_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.count_by(jobs.with_issue_month(_book(spark, sf_dir)), "issue_m")


def default_counts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.default_counts(_book(spark, sf_dir), "addr_state")


def _frequency(column: str) -> Query:
    return lambda spark, sf_dir: segments.frequency(_book(spark, sf_dir), column)


def mean_rate_of_defaults_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.col("loan_status") == DEFAULT_LABEL
    return rounded(segments.mean_by(_book(spark, sf_dir), "grade", "int_rate", where))


def mean_dti_by_term_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.mean_by(_book(spark, sf_dir), "term", "dti"))


def null_safe_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    totals = segments.count_by(book, "acc_now_delinq")
    return segments.left_join_null_safe(
        totals, segments.default_counts(book, "acc_now_delinq"), "acc_now_delinq"
    )


# -- row-level --------------------------------------------------------------


def exclude_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.exclude_statuses(loan_view(spark, sf_dir)).select("id", "loan_status")


def recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.exclude_statuses(loan_view(spark, sf_dir))
    return kept.select("id", recode_outcome(F.col("loan_status")).alias("outcome"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.exclude_statuses(loan_view(spark, sf_dir))
    return kept.select("id", binary_target(F.col("loan_status")).alias("target"))


def percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loan_view(spark, sf_dir).select(
        "id",
        parse_percent(F.col("int_rate")).alias("int_rate"),
        parse_percent(F.col("revol_util")).alias("revol_util"),
    )


def issue_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loan_view(spark, sf_dir).select("id", first_token(F.col("issue_d")).alias("issue_m"))


def ratio_to_funded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.with_ratios(loan_view(spark, sf_dir)).select("id", *RATIO_COLUMNS))


def classify_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = models.score(FIXED_PD, _book(spark, sf_dir), "p_paid")
    return scored.select(
        "id",
        classify(F.col("p_paid"), 0.62, above=1, below=0).cast("double").alias("predicted"),
        classify(F.col("p_paid"), 0.62, above=0, below=1).cast("double").alias("pd"),
    )


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = recovery_rate(F.col("recoveries"), F.col("funded_amnt")).alias("recovery_rate")
    return rounded(loan_view(spark, sf_dir).select("id", rate))


def conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = ccf(F.col("funded_amnt"), F.col("total_rec_prncp")).alias("ccf")
    return rounded(loan_view(spark, sf_dir).select("id", factor))


# -- profile ----------------------------------------------------------------


def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_shape(loan_view(spark, sf_dir), "id", samples=4)


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.preview(loan_view(spark, sf_dir), "id"))


def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = jobs.with_ratios(_staged_book(spark, sf_dir)).drop("id", "member_id")
    return rounded(profile.summarize_columns(book))


def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of the raw table, before any filter."""
    return profile.summarize_text(loan_view(spark, sf_dir))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.null_profile(_staged_book(spark, sf_dir)))


def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.sparse_columns(_book(spark, sf_dir)))


def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.constant_columns(_book(spark, sf_dir))


def kept_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.drop_columns(
        loan_view(spark, sf_dir), DROP_UNUSED + DROP_OBSERVED + DROP_REVIEWED
    )
    return profile.profile_shape(kept).select("column", "n_rows")


def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    shape = profile.profile_shape(book.select(*columns_of_type(book, "numeric")))
    return shape.select("column", "n_rows")


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(_staged_book(spark, sf_dir))


def _distinct(column: str) -> Query:
    return lambda spark, sf_dir: profile.distinct_values(_book(spark, sf_dir), column, "id")


def std_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.std_by_column(_staged_book(spark, sf_dir).drop("id", "member_id")), 4)


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    asked = [c for c in book.columns if c in {"loan_status", RATIO_DENOMINATOR, *STRICT_CLASS_MEANS, *CLASS_MEANS}]
    return rounded(jobs.outcome_means(jobs.with_ratios(stage(book.select(*asked), "book"))))


def histogram_int_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(_book(spark, sf_dir), "int_rate", RATE_BREAKS)


def histogram_default_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.histogram(_book(spark, sf_dir), "int_rate"))


def histogram_dti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(loan_view(spark, sf_dir), "dti", DTI_BREAKS)


def histogram_dti_default_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.histogram(loan_view(spark, sf_dir), "dti"))


def raw_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges straight over the view, before anything has settled what is missing."""
    return rounded(profile.range_of(loan_view(spark, sf_dir), list(NAN_EVERY)))


def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL and NaN of every column as the view has them."""
    return rounded(missing.missing_counts(loan_view(spark, sf_dir)))


# -- sketches ---------------------------------------------------------------

SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _merged_sketches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The staged book, and sketches of its columns merged from those of its grades, which are staged."""
    book = stage(_book(spark, sf_dir).drop("id", "member_id"), "book")
    columns = [c for c in book.columns if c != "grade"]
    sliced = stage(sketches.sketch_columns(book, columns, ["grade"]), "sketches")
    return book, stage(sketches.merge_sketches(sliced), "merged")


def sketched_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merged sketches keep exactly."""
    _, merged = _merged_sketches(spark, sf_dir)
    found = sketches.sketched_summary(merged)
    return rounded(found.select("column", "min", "mean", "max", "n_null"))


def sketched_quantile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, share, n, within): whether each sketched quantile's true rank is within the stated error."""
    book, merged = _merged_sketches(spark, sf_dir)
    found = stage(sketches.sketched_quantiles(merged, SHARES), "quantiles")
    values: dict[str, list[float]] = {}
    for r in found.orderBy("column", "share").collect():  # a few per column
        values.setdefault(r["column"], []).append(r["value"])
    ranks = sketches.ranks_of(book, values)
    spots = F.array(*[F.lit(s) for s in SHARES])
    checked = ranks.withColumn("share", spots[F.col("position")]).drop("position")
    off = F.greatest(F.col("below") - F.col("share"), F.col("share") - F.col("upto"))
    return found.join(checked, ["column", "share"], "left").select(
        "column", "share", "n", (off <= sketches.rank_error()).alias("within")
    )


def sketched_distinct_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, n_distinct, within): exact counts, and whether the merged sketches are within the stated error."""
    book, merged = _merged_sketches(spark, sf_dir)
    exact = profile.distinct_counts(book, [c for c in book.columns if c != "grade"])
    off = F.abs(F.col("estimate") - F.col("n_distinct"))
    estimates = merged.select("column", sketches.distinct_estimate().alias("estimate"))
    within = off <= F.lit(sketches.distinct_error()) * F.col("n_distinct")
    return exact.join(estimates, "column").select("column", "n_distinct", within.alias("within"))


def approximate_distinct_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the one-pass approximation, whose standard error is 5 %: five of them are allowed."""
    book = _staged_book(spark, sf_dir)
    exact = profile.distinct_counts(book)
    near = profile.distinct_counts(book, approximate=True).withColumnRenamed("n_distinct", "estimate")
    within = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.lit(0.25) * F.col("n_distinct")
    return exact.join(near, "column").select("column", "n_distinct", within.alias("within"))


PROFILE_TABLES = ("nulls", "class_means", "frequency_purpose")


def _profile_table(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(jobs.portfolio_profile(loan_view(spark, sf_dir))[name])

    return run


def impute_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.column_means(jobs.with_ratios(_book(spark, sf_dir)), IMPUTED_COLUMNS))


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = jobs.with_ratios(_book(spark, sf_dir)).select("id", *IMPUTED_COLUMNS)
    return rounded(clean.impute_mean(book, IMPUTED_COLUMNS))


def prepared_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = _prepared(spark, sf_dir)
    return rounded(
        loans.select(
            *[F.col(c).cast("double").alias(c) if c in columns_of_type(loans, "integer") and c != "id"
              else F.col(c) for c in loans.columns]
        )
    )


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "loans-csv")
    loan_view(spark, sf_dir).write.csv(
        path, header=True, nullValue="NA", escape='"', ignoreLeadingWhiteSpace=False
    )
    return rounded(read_loans(spark, path))


# Columns that no list names, of every type in the lattice, made from a loan's key.
UNKNOWN_COLUMNS = {
    "x_flag": "case when id % 11 = 0 then 'NA' when id % 2 = 0 then 'TRUE' else 'false' end",
    "x_whole": "case when id % 13 = 0 then '' else cast(id * 3 - 50 as string) end",
    "x_long": "'1' || cast(id as string) || '00000000000000000000'",
    "x_amount": "case when id % 17 = 0 then 'NaN' else cast(id as string) || '.25' end",
    "x_mixed": "case when id % 97 = 3 then 'n/a' else cast(id as string) end",
    "x_letter": "cast(id as string) || 'd'",
    "x_empty": "case when id % 2 = 0 then 'NA' else '' end",
}


def _unknown_csv(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "unknown-csv")
    rows = plain_loan_view(spark, sf_dir).selectExpr("id", *[f"{sql} as {c}" for c, sql in UNKNOWN_COLUMNS.items()])
    rows.write.csv(path, header=True, escape='"', emptyValue="")
    return path


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.csv(_unknown_csv(spark, sf_dir), header=True, quote='"', escape='"')
    return infer_types(raw, list(UNKNOWN_COLUMNS))


def typed_unknown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read_loans(spark, _unknown_csv(spark, sf_dir)))


LINE_COLUMNS = ["id", "loan_status", "purpose", "dti"]


def _broken_lines(spark: SparkSession, sf_dir: str) -> str:
    """Lines of four fields; some lack the last one, some have one more."""
    path = new_path(spark, "lines")
    fields = "id || ',' || loan_status || ',' || purpose"
    line = f"""case when id % 37 = 0 then {fields} when id % 41 = 0 then {fields} || ',1,2'
 else {fields} || ',' || coalesce(cast(cast(dti as decimal(9,2)) as string), 'NA') end"""
    plain_loan_view(spark, sf_dir).selectExpr(f"{line} as value").write.text(path)
    return path


def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed_lines(spark, _broken_lines(spark, sf_dir), names=LINE_COLUMNS)


def well_formed_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read_loans(spark, _broken_lines(spark, sf_dir), names=LINE_COLUMNS, drop_malformed=True))


# -- associations -----------------------------------------------------------


def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine pairs, after imputation of what is imputed."""
    used = sorted({c for pair in CORRELATION_PAIRS for c in pair})
    book = _book(spark, sf_dir).select(*used)
    filled = clean.impute_mean(book, [c for c in used if c in IMPUTED_COLUMNS])
    return rounded(associate.pearson_pairs(filled, CORRELATION_PAIRS))


def corr_pairs_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    return rounded(associate.pearson_pairs(book, CORRELATION_PAIRS, strict_nulls=False))


def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.screen_features(_prepared(spark, sf_dir)).matrix)


def correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = jobs.screen_features(_prepared(spark, sf_dir)).matrix
    return rounded(associate.correlated_pairs(matrix, MIN_ABS_R))


def pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a strong pair makes superfluous, with the one that stays in their place."""
    return rounded(jobs.screen_features(_prepared(spark, sf_dir)).pruned())


def prepared_pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the table that is prepared without the pruned ones, with its rows."""
    raw = loan_view(spark, sf_dir)
    loans = jobs.prepare_loans(raw, drop=jobs.pruned_features(raw)).loans
    return profile.profile_shape(loans).select("column", "n_rows")


def _woe(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        book = _book(spark, sf_dir).select(
            binary_target(F.col("loan_status")).alias("loan_status"), column
        )
        return rounded(associate.woe_table(book, "loan_status", [column]))

    return run


def information_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.screen_features(_prepared(spark, sf_dir)).information_value)


def screening_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.screen_features(_prepared(spark, sf_dir)).pairs)


def woe_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text predictor with a level for every seven loans: none is left out."""
    level = F.concat(F.lit("v"), F.floor(F.col("id") / 28).cast("string"))
    book = _book(spark, sf_dir).select(
        binary_target(F.col("loan_status")).alias("loan_status"), level.alias("level")
    )
    return rounded(associate.woe_table(book, "loan_status", ["level"]))


def many_strata_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the loans in one stratum, small strata for all others."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / 40))
    book = _book(spark, sf_dir).select("id", key.cast("long").alias("stratum"))
    return split.stratified_split(book, "id", "stratum")


def quantiles_by_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles with so small a limit that brackets must be narrowed again and again."""
    book = stage(_book(spark, sf_dir).select("dti", "int_rate", "annual_inc", "open_rv_12m"), "book")
    found = interpolated_quantiles(
        book, book.columns, ["0.25", "0.5", "0.75"], max_values=50, sketch_error=0.05
    )
    rows = [(c, *map(float, q)) for c, q in found.items()]
    return rounded(spark.createDataFrame(rows, "column string, q1 double, median double, q3 double"))


# -- split and models -------------------------------------------------------


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir).select("id", binary_target(F.col("loan_status")).alias("target"))
    return split.stratified_split(book, "id", "target")


def _target_split(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        defaults = loss.default_targets(_targeted(spark, sf_dir))
        return split.stratified_split(defaults.select("id", column), "id", column).select(
            "id", "is_train"
        )

    return run


def default_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = loss.default_targets(_targeted(spark, sf_dir))
    return rounded(defaults.select("id", "recovery_rate", "ccf"))


def target_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of both targets, the recovery before its cap."""
    defaults = loss.default_targets(_targeted(spark, sf_dir))
    uncapped = defaults.select(F.col("recovery_share").alias("recovery_rate"), "ccf")
    return rounded(profile.range_of(uncapped, ["recovery_rate", "ccf"]))


def _model(trained: jobs.Trained, name: str) -> tuple[models.LinearModel, DataFrame]:
    return getattr(trained, name), getattr(trained, f"{name}_rows")


def _fit_moments(name: str) -> Query:
    """What least squares fixes: per level and per slope, predictions sum up as the targets do."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows = _model(_trained(spark, sf_dir, name), name)
        train = models.score(model, rows.filter("is_train"))
        p = F.col("prediction")
        # More digits for the means: those of two-digit targets can end in a 5.
        keys = rounded(segments_of(train, ["sub_grade", "term"], F.avg(p)), 7)
        sums = train.agg(F.sum(p * F.col("int_rate")).alias("r"), F.sum(p * F.col("dti")).alias("d"))
        slopes = sums.selectExpr(
            "inline(array(named_struct('moment', 'int_rate', 'value', r),"
            " named_struct('moment', 'dti', 'value', d)))"
        )
        return keys.unionAll(rounded(slopes, 4))

    return run


def segments_of(df: DataFrame, keys: Sequence[str], aggregate: Column) -> DataFrame:
    first, *rest = [
        df.groupBy(F.col(k).alias("moment")).agg(aggregate.alias("value")) for k in keys
    ]
    for other in rest:
        first = first.unionAll(other)
    return first


def _coefficients(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = models.coefficient_table(spark, _model(_trained(spark, sf_dir, name), name)[0])
        return rounded(table.drop("p_value"), 5, t_value=4)

    return run


def _p_values(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, _ = _model(_trained(spark, sf_dir, name), name)
        return rounded(models.coefficient_table(spark, model).select("term", "p_value"), 5)

    return run


def scores_of_unseen_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans of a sub-grade that the training rows lack have no score."""
    trained = _trained(spark, sf_dir, "pd", without=F.col("sub_grade") == UNSEEN_LEVEL)
    scored = models.score(trained.pd, trained.pd_rows)
    return rounded(scored.agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.count_if(F.col("prediction").isNull()).alias("n_unscored"),
        F.avg("prediction").alias("mean_score"),
    ))


def _many_level_fit(spark: SparkSession, sf_dir: str) -> tuple[models.Model, DataFrame]:
    """The repayment model with a level for one or two loans in the place of the sub-grade."""
    level = F.concat(F.lit("v"), F.floor(F.col("id") / 5).cast("string"))
    book = stage(_targeted(spark, sf_dir).withColumn("sub_grade", level), "levels")
    rows = stage(split.stratified_split(book.select("id", "loan_status", *PREDICTORS), "id", "loan_status"), "split")
    # the limit is lowered so that the small tables are fitted by the same path as large ones
    return models.fit(rows.filter("is_train"), "loan_status", PREDICTORS, most=64), rows


def many_level_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_many_level_fit(spark, sf_dir)[0].coefficients(), 5, t_value=4)


def many_level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all loans; those of a level without a training row have none."""
    model, rows = _many_level_fit(spark, sf_dir)
    return rounded(models.score(model, rows).select("id", "prediction"))


def many_level_fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _many_level_fit(spark, sf_dir)
    return rounded(models.fit_stats(model, rows.filter("is_train")).select("n", "df_model", "df_residual", "r2", "sigma"), 5)


def _fit_stats(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows = _model(_trained(spark, sf_dir, name), name)
        return rounded(models.fit_stats(model, rows.filter("is_train")), 6, aic=3, f_statistic=4,
                       deviance=4, null_deviance=4)

    return run


def confusion_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.confusion(_fixed_scores(spark, sf_dir), "predicted", "loan_status")


def accuracy_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.accuracy(_fixed_scores(spark, sf_dir), "predicted", "loan_status"))


def error_metrics_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.error_metrics(_fixed_scores(spark, sf_dir), "loan_status", "p_paid"))


def residual_histogram_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _fixed_scores(spark, sf_dir)
    return rounded(profile.histogram(scored, "residual", RESIDUAL_BREAKS))


def residual_trend_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.residual_trend(_fixed_scores(spark, sf_dir), "p_paid", "residual"))


def expected_loss_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _fixed_loss(spark, sf_dir)
    return rounded(
        scored.select("id", "p_paid", "recovery_rate", "ccf", "LGD", "EAD", "PD", "EL"), 6,
        EAD=4, EL=4,
    )


def portfolio_loss_fixed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(loss.portfolio_loss(_fixed_loss(spark, sf_dir)), 4, el_share=9)


def portfolio_loss_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without imputation some loans have no score: the lenient totals."""
    scored = _fixed_loss(spark, sf_dir, impute=False)
    return rounded(loss.portfolio_loss(scored, strict_nulls=False), 4, el_share=9)


def portfolio_loss_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without imputation the strict totals are void."""
    return loss.portfolio_loss(_fixed_loss(spark, sf_dir, impute=False))


# -- fitted end to end ------------------------------------------------------


def pd_test_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.evaluate_pd(_trained(spark, sf_dir, "pd"))["confusion"]


def pd_test_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.evaluate_pd(_trained(spark, sf_dir, "pd"))["accuracy"])


def _fitted_errors(name: str, part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows = _model(_trained(spark, sf_dir, name), name)
        kept = rows.filter("is_train" if part == "train" else "not is_train")
        return rounded(jobs.evaluate_ols(model, kept)["errors"], 5)

    return run


def _fitted_residuals(name: str, table: str, part: str = "test") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows = _model(_trained(spark, sf_dir, name), name)
        scored = models.with_residual(
            models.score(model, rows.filter("is_train" if part == "train" else "not is_train")),
            model.target, "prediction",
        )
        if table == "histogram":
            return rounded(profile.histogram(scored, "residual", RESIDUAL_BREAKS))
        return rounded(models.residual_trend(scored, "prediction", "residual"), 5)

    return run


def expected_loss_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored loans, written to Parquet and read back."""
    scored, _ = jobs.expected_loss_run(_prepared(spark, sf_dir))
    path = new_path(spark, "scored")
    write_scored(scored, path)
    scored = spark.read.parquet(path)
    return rounded(
        scored.select("id", "p_paid", "recovery_rate", "ccf", "LGD", "EAD", "PD", "EL"), 4,
        EAD=2, EL=2,
    )


def portfolio_loss_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = jobs.expected_loss_run(_prepared(spark, sf_dir))
    return rounded(totals, 4, el_share=9)


def all_queries() -> dict[str, Query]:
    by_segment = {
        f"default_rate_by_{key}": _segment_rate(key)
        for key in [*SEGMENT_KEYS, "purpose", "issue_m"]
    }
    frequencies = {f"frequency_{c}": _frequency(c) for c in FREQUENCY_COLUMNS}
    fitted = {}
    for name in ("pd", "lgd", "ead"):
        fitted[f"{name}_fit_moments"] = _fit_moments(name)
        fitted[f"{name}_coefficients"] = _coefficients(name)
        fitted[f"{name}_fit_stats"] = _fit_stats(name)
    for name in ("lgd", "ead"):
        fitted[f"{name}_errors_train"] = _fitted_errors(name, "train")
        fitted[f"{name}_errors_test"] = _fitted_errors(name, "test")
        fitted[f"{name}_residual_histogram"] = _fitted_residuals(name, "histogram")
        fitted[f"{name}_residual_trend"] = _fitted_residuals(name, "trend")
        fitted[f"{name}_residual_histogram_train"] = _fitted_residuals(name, "histogram", "train")
        fitted[f"{name}_residual_trend_train"] = _fitted_residuals(name, "trend", "train")
        fitted[f"{name}_p_values"] = _p_values(name)
    planted = {
        f"nan_{name}": with_nan(query)
        for name, query in {
            "null_profile": null_profile,
            "column_summary": column_summary,
            "std_by_column": std_by_column,
            "class_means": class_means,
            "impute_means": impute_means,
            "imputed": imputed,
            "prepared_loans": prepared_loans,
            "raw_ranges": raw_ranges,
            "target_ranges": target_ranges,
            "histogram_dti": histogram_dti,
            "histogram_dti_default_breaks": histogram_dti_default_breaks,
            "mean_dti_by_term_strict": mean_dti_by_term_strict,
            "distinct_values_dti": _distinct("dti"),
            "distinct_counts": distinct_counts,
            "corr_pairs_incomplete": corr_pairs_incomplete,
            "woe_dti": _woe("dti"),
            "csv_round_trip": csv_round_trip,
            "portfolio_loss_unscored": portfolio_loss_unscored,
            "missing_counts": missing_counts,
        }.items()
    }
    return {
        **planted,
        "missing_counts": missing_counts,
        "raw_ranges": raw_ranges,
        "histogram_dti": histogram_dti,
        "histogram_dti_default_breaks": histogram_dti_default_breaks,
        "sketched_moments": sketched_moments,
        "sketched_quantile_ranks": sketched_quantile_ranks,
        "sketched_distinct_within": sketched_distinct_within,
        "approximate_distinct_within": approximate_distinct_within,
        "inferred_types": inferred_types,
        "typed_unknown_columns": typed_unknown_columns,
        "quarantined_lines": quarantined_lines,
        "well_formed_loans": well_formed_loans,
        "pruned_columns": pruned_columns,
        "prepared_pruned_columns": prepared_pruned_columns,
        "default_rate_by_grade": default_rate_by_grade,
        **by_segment,
        "segment_report": segment_report,
        "status_counts_raw": status_counts_raw,
        "status_counts_recoded": status_counts_recoded,
        "issue_month_counts": issue_month_counts,
        "default_counts_by_state": default_counts_by_state,
        **frequencies,
        "mean_rate_of_defaults_by_grade": mean_rate_of_defaults_by_grade,
        "mean_dti_by_term_strict": mean_dti_by_term_strict,
        "null_safe_left_join": null_safe_left_join,
        "exclude_unresolved": exclude_unresolved,
        "recode_outcome": recode,
        "binary_target": target,
        "parse_percent": percent,
        "issue_month": issue_month,
        "ratio_to_funded": ratio_to_funded,
        "classify_threshold": classify_threshold,
        "recovery_rate": recovery,
        "ccf": conversion,
        "shape": shape,
        "preview": preview,
        "column_summary": column_summary,
        "text_summary": text_summary,
        "null_profile": null_profile,
        "sparse_columns": sparse_columns,
        "constant_columns": constant_columns,
        "kept_columns": kept_columns,
        "numeric_columns": numeric_columns,
        "distinct_counts": distinct_counts,
        "distinct_values_term": _distinct("term"),
        "distinct_values_desc": _distinct("desc"),
        "distinct_values_dti": _distinct("dti"),
        "std_by_column": std_by_column,
        "class_means": class_means,
        "histogram_int_rate": histogram_int_rate,
        "histogram_default_breaks": histogram_default_breaks,
        **{f"portfolio_profile_{t}": _profile_table(t) for t in PROFILE_TABLES},
        "impute_means": impute_means,
        "imputed": imputed,
        "prepared_loans": prepared_loans,
        "csv_round_trip": csv_round_trip,
        "corr_pairs": corr_pairs,
        "corr_pairs_incomplete": corr_pairs_incomplete,
        "corr_matrix": corr_matrix,
        "correlated_pairs": correlated_pairs,
        "woe_int_rate": _woe("int_rate"),
        "woe_dti": _woe("dti"),
        "woe_sub_grade": _woe("sub_grade"),
        "information_value": information_value,
        "screening_pairs": screening_pairs,
        "woe_many_levels": woe_many_levels,
        "many_strata_split": many_strata_split,
        "quantiles_by_brackets": quantiles_by_brackets,
        "stratified_split": stratified_split,
        "recovery_split": _target_split("recovery_rate"),
        "ccf_split": _target_split("ccf"),
        "default_targets": default_targets,
        "target_ranges": target_ranges,
        **fitted,
        "coefficient_p_values": _p_values("pd"),
        "scores_of_unseen_level": scores_of_unseen_level,
        "many_level_slopes": many_level_slopes,
        "many_level_scores": many_level_scores,
        "many_level_fit_stats": many_level_fit_stats,
        "confusion_fixed_score": confusion_fixed_score,
        "accuracy_fixed_score": accuracy_fixed_score,
        "error_metrics_fixed_score": error_metrics_fixed_score,
        "residual_histogram_fixed_score": residual_histogram_fixed_score,
        "residual_trend_fixed_score": residual_trend_fixed_score,
        "expected_loss_fixed_score": expected_loss_fixed_score,
        "portfolio_loss_fixed_score": portfolio_loss_fixed_score,
        "portfolio_loss_unscored": portfolio_loss_unscored,
        "portfolio_loss_void": portfolio_loss_void,
        "pd_test_confusion": pd_test_confusion,
        "pd_test_accuracy": pd_test_accuracy,
        "expected_loss_fitted": expected_loss_fitted,
        "portfolio_loss_fitted": portfolio_loss_fitted,
    }

"""The jobs a user calls: prepare, profile, report, screen, train, score."""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import (
    binary_target,
    classify,
    first_token,
    parse_percent,
    recode_outcome,
)
from riskbook.functions.text import quoted
from riskbook.operators import (
    associate,
    clean,
    loss,
    models,
    profile,
    segments,
    split,
)
from riskbook.operators.missing import missing_counts, nan_to_null
from riskbook.schema import (
    CLASS_MEANS,
    CORRELATION_PAIRS,
    DEFAULT_LABEL,
    DROP_OBSERVED,
    DROP_REVIEWED,
    DROP_UNUSED,
    FREQUENCY_COLUMNS,
    IMPUTED_COLUMNS,
    LOSS_INPUTS,
    MAX_NULL_SHARE,
    MIN_ABS_R,
    PERCENT_COLUMNS,
    PREDICTORS,
    RATIO_COLUMNS,
    RATIO_DENOMINATOR,
    SCORE_CUT,
    SEGMENT_KEYS,
    STRICT_CLASS_MEANS,
    columns_of_type,
    present,
)
from riskbook.sources.staging import stage, stage_observed


def resolve(loans: DataFrame) -> DataFrame:
    """Loans with a settled outcome: status recoded, percent text as numbers, NaN as NULL."""
    percent = present(loans, PERCENT_COLUMNS)
    return clean.exclude_statuses(nan_to_null(loans)).withColumns(
        {
            "loan_status": recode_outcome(F.col("loan_status")),
            **{c: parse_percent(F.col(c)) for c in percent},
        }
    )


def with_ratios(loans: DataFrame) -> DataFrame:
    return clean.ratio_to(loans, present(loans, RATIO_COLUMNS), RATIO_DENOMINATOR)


class LazyTables(Mapping[str, DataFrame]):
    """Tables by name, each made when it is first asked for; others cost no job."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


# -- prepare ----------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """The cleaned table, over a staged one, and what the data decided about it."""

    loans: DataFrame
    dropped_sparse: list[str]
    dropped_constant: list[str]
    means: dict[str, float | None]


def prepare_loans(raw: DataFrame, key: str = "id", drop: Sequence[str] = tuple(DROP_REVIEWED)) -> Prepared:
    """Clean the raw table up to the 0/1 target.

    Only the columns that can stay are staged, and the pass that writes them
    also finds their null shares, the constant ones and the imputation means;
    the cleaned table is a projection of the staged one. The ratios are taken
    before their imputation, and all rows count for a mean. The key stays in
    the table, because the splits need it. `drop` names what goes besides the
    unread columns: the reviewed ones, or a list that `pruned_features` gave.
    """
    kept = resolve(raw).drop(*({*DROP_UNUSED, *DROP_OBSERVED, "grade", "issue_d"} - {key}))
    columns = [c for c in kept.columns if c != key]
    imputed = present(kept, IMPUTED_COLUMNS)

    def mean(name: str) -> str:
        value = f"double({quoted(name)})"
        if name in RATIO_COLUMNS:
            value = f"try_divide({value}, double({quoted(RATIO_DENOMINATOR)}))"
        return f"avg({value})"

    metrics = {label: F.expr(sql) for label, sql in clean.screen_metrics(kept, columns).items()}
    metrics |= {f"mean_{i}": F.expr(mean(c)) for i, c in enumerate(imputed)}
    staying = [c for c in kept.columns if c not in drop or c == RATIO_DENOMINATOR]
    staged, seen = stage_observed(kept, "kept", metrics, staying)

    null_share, constant = clean.screened(kept, columns, seen)
    sparse = [c for c in columns if (null_share[c] or 0.0) > MAX_NULL_SHARE]
    constant = [c for c in constant if c not in sparse]
    means = {c: seen[f"mean_{i}"] for i, c in enumerate(imputed)}
    kept = with_ratios(staged).drop(*sparse, *constant)
    filled = clean.fill_missing(kept, {c: m for c, m in means.items() if c in kept.columns})
    loans = clean.drop_columns(filled, drop).withColumn("loan_status", binary_target(F.col("loan_status")))
    return Prepared(loans, sparse, constant, means)


# -- profile ----------------------------------------------------------------


def portfolio_profile(raw: DataFrame, key: str = "id", samples: int = 4) -> LazyTables:
    """Tables that describe the resolved book, before imputation.

    What takes one or two passes reads the raw table; the tables that take
    many share one staged book, written when the first of them is asked for.
    """
    book = with_ratios(resolve(raw))
    numeric = columns_of_type(book, "numeric")
    staged = LazyTables({"book": lambda: stage(book, "book")})
    return LazyTables(
        {
            "shape": lambda: profile.profile_shape(book, key, samples),
            "missing": lambda: missing_counts(raw),
            "summary": lambda: profile.summarize_columns(staged["book"], numeric),
            "nulls": lambda: profile.null_profile(staged["book"]),
            "distinct": lambda: profile.distinct_counts(staged["book"]),
            "std": lambda: profile.std_by_column(staged["book"], numeric),
            "class_means": lambda: outcome_means(staged["book"]),
            **{
                f"frequency_{c}": partial(segments.frequency, book, c)
                for c in present(book, FREQUENCY_COLUMNS)
            },
        }
    )


def outcome_means(book: DataFrame) -> DataFrame:
    """(column, mean_paid, mean_default) of the profiled columns."""
    strict = present(book, STRICT_CLASS_MEANS)
    return profile.class_means(book, strict + present(book, CLASS_MEANS), strict_nulls=strict)


# -- report -----------------------------------------------------------------


def grade_report(book: DataFrame) -> DataFrame:
    """(grade, count, default_count, default_rate in percent)."""
    return segments.segment_default_rate(book, "grade", scale=100.0)


def with_issue_month(book: DataFrame) -> DataFrame:
    return book.withColumn("issue_m", first_token(F.col("issue_d")))


def segment_risk_report(raw: DataFrame) -> dict[str, DataFrame]:
    """Default rates by grade and by every segment, and what goes with them."""
    book = resolve(raw)
    return {
        "by_grade": grade_report(book),
        "by_segment": segments.segment_report(book, present(book, SEGMENT_KEYS)),
        "rate_of_defaults_by_grade": segments.mean_by(
            book, "grade", "int_rate", F.col("loan_status") == DEFAULT_LABEL
        ),
        "issue_months": segments.count_by(with_issue_month(book), "issue_m"),
    }


# -- screen -----------------------------------------------------------------


class Screening:
    """Correlations among the features and their information about the target, each made when asked for."""

    def __init__(self, prepared: DataFrame, key: str = "id", target: str = "loan_status"):
        self.prepared, self.target = prepared, target
        self.features = [c for c in prepared.columns if c not in (key, target)]
        self.numeric = [c for c in columns_of_type(prepared, "numeric") if c in self.features]

    @cached_property
    def pairs(self) -> DataFrame:
        known = [(a, b) for a, b in CORRELATION_PAIRS if {a, b} <= set(self.numeric)]
        return associate.pearson_pairs(self.prepared, known)

    @cached_property
    def matrix(self) -> DataFrame:
        """All numeric features."""
        return associate.correlation_matrix(self.prepared, self.numeric)

    @cached_property
    def woe(self) -> DataFrame:
        return associate.woe_table(self.prepared, self.target, self.features)

    @cached_property
    def information_value(self) -> DataFrame:
        return associate.information_value(self.woe)

    def pruned(
        self, min_abs_r: float = MIN_ABS_R, protected: Sequence[str] = tuple(PREDICTORS + LOSS_INPUTS)
    ) -> DataFrame:
        """(column, kept_column, r): which column of each strong pair goes.

        The models' predictors and the inputs of the loss stay; of two others the
        one that says more about the target does.
        """
        matrix = associate.correlation_matrix(self.prepared, [*self.numeric, self.target])
        order = associate.prune_order(matrix, self.target, protected)
        return associate.prune_correlated(matrix, min_abs_r, order, protected)


def screen_features(prepared: DataFrame, key: str = "id", target: str = "loan_status") -> Screening:
    return Screening(prepared, key, target)


def pruned_features(raw: DataFrame, key: str = "id", min_abs_r: float = MIN_ABS_R) -> list[str]:
    """What `prepare_loans` should drop: the reviewed columns, and those that a strong pair makes superfluous."""
    prepared = prepare_loans(raw, key).loans
    return DROP_REVIEWED + [r["column"] for r in Screening(prepared, key).pruned(min_abs_r).collect()]


# -- train ------------------------------------------------------------------


MODELS = ("pd", "lgd", "ead")


@dataclass(frozen=True)
class Trained:
    """The fitted models and the split tables they were fitted on; None if not asked for."""

    pd: models.Model | None = None
    lgd: models.Model | None = None
    ead: models.Model | None = None
    pd_rows: DataFrame | None = None
    lgd_rows: DataFrame | None = None
    ead_rows: DataFrame | None = None


def train_models(
    prepared: DataFrame,
    key: str = "id",
    target: str = "loan_status",
    predictors: Sequence[str] = tuple(PREDICTORS),
    wanted: Sequence[str] = MODELS,
    without: Column | None = None,
) -> Trained:
    """Fit the wanted models of repayment, recovery and conversion on their training rows.

    The rows of each model are staged with their split, so that fit, summary and
    evaluation read a few narrow columns; `prepared` should rest on a staged table.
    `without` leaves training rows out.
    """
    defaults = loss.default_targets(prepared, target).select(key, "recovery_rate", "ccf", *predictors)
    if {"lgd", "ead"} <= set(wanted):  # both read the few defaulted rows
        defaults = stage(defaults, "defaults")
    sources = {"pd": (prepared, target), "lgd": (defaults, "recovery_rate"), "ead": (defaults, "ccf")}

    def fit(name: str) -> tuple[models.Model, DataFrame]:
        rows, y = sources[name]
        marked = stage(split.stratified_split(rows.select(key, y, *predictors), key, y), f"{name}-split")
        train = marked.filter("is_train")
        return models.fit(train if without is None else train.filter(~without), y, predictors), marked

    # The fits do not depend on each other, so their jobs run side by side.
    with ThreadPoolExecutor(len(wanted)) as pool:
        inherit = inheritable_thread_target(prepared.sparkSession)
        fits = {name: pool.submit(contextvars.copy_context().run, inherit(fit), name) for name in wanted}
        done = {name: f.result() for name, f in fits.items()}
    return Trained(**{n: m for n, (m, _) in done.items()}, **{f"{n}_rows": r for n, (_, r) in done.items()})


def evaluate_pd(trained: Trained, threshold: float = SCORE_CUT) -> dict[str, DataFrame]:
    """Confusion matrix and accuracy on the rows kept out of training."""
    test = models.score(trained.pd, trained.pd_rows.filter("not is_train"), "p_paid")
    test = test.withColumn("predicted", classify(F.col("p_paid"), threshold, above=1, below=0))
    return {
        "confusion": models.confusion(test, "predicted", trained.pd.target),
        "accuracy": models.accuracy(test, "predicted", trained.pd.target),
    }


def evaluate_ols(model: models.Model, rows: DataFrame) -> dict[str, DataFrame]:
    """Errors, residual histogram and residual trend of a model over some rows."""
    scored = models.with_residual(models.score(model, rows), model.target, "prediction")
    return {
        "errors": models.error_metrics(scored, model.target, "prediction"),
        "histogram": profile.histogram(scored, "residual"),
        "trend": models.residual_trend(scored, "prediction", "residual"),
    }


# -- score ------------------------------------------------------------------


def score_book(prepared: DataFrame, trained: Trained, threshold: float = SCORE_CUT) -> DataFrame:
    """Every loan with its predictions and expected loss; a join only for absorbed levels."""
    scored = prepared
    for model, out in ((trained.pd, "p_paid"), (trained.lgd, "recovery_rate"), (trained.ead, "ccf")):
        scored = models.score(model, scored, out)
    return loss.expected_loss(scored, F.col("p_paid"), F.col("recovery_rate"), F.col("ccf"), threshold)


def expected_loss_run(prepared: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Train, score the whole book, and total it: (scored loans, totals)."""
    scored = score_book(prepared, train_models(prepared, key))
    return scored, loss.portfolio_loss(scored)

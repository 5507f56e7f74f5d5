"""The same results as plain SQL for DuckDB, written without the library's operators."""

from __future__ import annotations

from collections.abc import Sequence

from riskbook.plans.queries import (
    DTI_BREAKS,
    FREQUENCY_COLUMNS,
    MIN_ABS_R,
    NAN_EVERY,
    RATE_BREAKS,
    RESIDUAL_BREAKS,
    SHARES,
    UNKNOWN_COLUMNS,
    UNSEEN_LEVEL,
)
from riskbook.schema import (
    CLASS_MEANS,
    CORRELATION_PAIRS,
    DROP_OBSERVED,
    DROP_REVIEWED,
    DROP_UNUSED,
    IMPUTED_COLUMNS,
    KEY_COLUMNS,
    LOSS_INPUTS,
    PERCENT_COLUMNS,
    PREDICTORS,
    RATIO_COLUMNS,
    SEGMENT_KEYS,
    STRICT_CLASS_MEANS,
    TEXT_COLUMNS,
)
from riskbook.sources.loan_view import MONTH_YEAR_DUCKDB, column_expressions, loan_view_sql

VIEW_COLUMNS = list(column_expressions(MONTH_YEAR_DUCKDB))
# Numeric columns of the view that no preset names.
NUMERIC = [
    c for c in VIEW_COLUMNS if c not in TEXT_COLUMNS and c not in PERCENT_COLUMNS + KEY_COLUMNS
]
NUMERIC_BOOK = [c for c in VIEW_COLUMNS if c not in TEXT_COLUMNS]


def rnd(expression: str, digits: int = 6) -> str:
    # + 0.0 turns a negative zero into zero.
    return f"round({expression}, {digits}) + cast(0 as double)"


def d(value: float | str) -> str:
    return f"cast({value} as double)"


def _in(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_OUTCOME = "case when loan_status like '%Paid%' then loan_status else 'Default' end"
_UNRESOLVED = _in(["In Grace Period", "Late (16-30 days)", "Current"])

LOANS = f"loans as materialized (\n{loan_view_sql()}\n)"
# The view with its planted NaN, which is nothing but a missing value.
_PLANTED = ", ".join(f"case when id % {n} = 0 then null else cast({c} as double) end as {c}" for c, n in NAN_EVERY.items())
NAN_LOANS = f"loans as materialized (\nselect * replace ({_PLANTED}) from (\n{loan_view_sql()}\n)\n)"
BOOK = f"""book as materialized (
 select * replace (
  {_OUTCOME} as loan_status,
  try_cast(replace(int_rate, '%', '') as double) as int_rate,
  try_cast(replace(revol_util, '%', '') as double) as revol_util)
 from loans where loan_status not in ({_UNRESOLVED})
)"""
_RATIOS = ", ".join(f"cast({c} as double) / nullif(funded_amnt, 0) as {c}" for c in RATIO_COLUMNS)
RATIO_BOOK = f"ratio_book as materialized (select * replace ({_RATIOS}) from book)"
TARGETED = """targeted as materialized (
 select id, sub_grade, term, int_rate, funded_amnt, recoveries, total_rec_prncp,
  cast(loan_status like '%Paid%' as int) as y,
  coalesce(dti, (select avg(dti) from book)) as dti
 from book
)"""
DEFAULTS = """defaults as materialized (
 select *, case when recoveries / nullif(funded_amnt, 0) > 1 then cast(1 as double)
   else recoveries / nullif(funded_amnt, 0) end as recovery_rate,
  recoveries / nullif(funded_amnt, 0) as recovery_share,
  (funded_amnt - total_rec_prncp) / nullif(funded_amnt, 0) as ccf
 from targeted where y = 0
)"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts)


def _loans(select: str) -> str:
    return f"{_with(LOANS)}\n{select}"


def _book(select: str) -> str:
    return f"{_with(LOANS, BOOK)}\n{select}"


def _ratio_book(select: str) -> str:
    return f"{_with(LOANS, BOOK, RATIO_BOOK)}\n{select}"


def _union(parts: Sequence[str]) -> str:
    return "\nunion all\n".join(parts)


# -- segments ---------------------------------------------------------------


def _rate(key: str, scale: int = 1, key_sql: str | None = None) -> str:
    source = key_sql or key
    return _book(f"""select t.k as {key}, t.n as "count", f.n as default_count,
 {rnd(f"{d(scale)} * f.n / t.n")} as default_rate
from (select {source} as k, count(*) as n from book group by 1) t
left join (select {source} as k, count(*) as n from book where loan_status = 'Default' group by 1) f
 on t.k is not distinct from f.k""")


def _segment_report() -> str:
    rows = _union(
        [f"select '{k}' as segment, cast({k} as varchar) as value, loan_status from book" for k in SEGMENT_KEYS]
    )
    return _book(f"""select segment, value, count(*) as "count",
 nullif(count(*) filter (loan_status = 'Default'), 0) as default_count,
 {rnd("nullif(count(*) filter (loan_status = 'Default'), 0) / cast(count(*) as double)")} as default_rate
from ({rows}) group by segment, value""")


def _frequency(column: str) -> str:
    return _book(
        f'select {column}, count(*) as "count" from book where {column} is not null group by 1'
    )


_KEPT = f"from loans where loan_status not in ({_UNRESOLVED})"

# -- profile ----------------------------------------------------------------


def _summary() -> str:
    return _ratio_book(_union([
        f"""select '{c}' as "column", {rnd(f'cast(min("{c}") as double)')} as "min",
 {rnd(f'quantile_cont(cast("{c}" as double), 0.25)')} as q1,
 {rnd(f'quantile_cont(cast("{c}" as double), 0.5)')} as median,
 {rnd(f'avg(cast("{c}" as double))')} as mean,
 {rnd(f'quantile_cont(cast("{c}" as double), 0.75)')} as q3,
 {rnd(f'cast(max("{c}") as double)')} as "max",
 count(*) - count("{c}") as n_null from ratio_book"""
        for c in NUMERIC_BOOK if c not in KEY_COLUMNS
    ]))


def _nulls(having: str = "") -> str:
    if having:
        return _book("select * from (" + _union([
            f"""select '{c}' as "column", {rnd(f'(count(*) - count("{c}")) / cast(count(*) as double)')} as null_share
from book""" for c in VIEW_COLUMNS
        ]) + f") where {having}")
    return _book(_union([
        f"""select '{c}' as "column", count(*) - count("{c}") as n_null,
 {rnd(f'(count(*) - count("{c}")) / cast(count(*) as double)')} as frac_null,
 count(*) > count("{c}") as any_null from book""" for c in VIEW_COLUMNS
    ]))


def _constant() -> str:
    parts = []
    for c in VIEW_COLUMNS:
        if c in TEXT_COLUMNS:
            rule = f'count(distinct "{c}") + max(cast("{c}" is null as int)) = 1'
        else:
            rule = f'count(*) = count("{c}") and stddev_samp(cast("{c}" as double)) = 0'
        parts.append(f"""select '{c}' as "column" from book having {rule}""")
    return _book(_union(parts))


def _distinct_counts() -> str:
    return _book(_union([
        f"""select '{c}' as "column",
 cast(count(distinct "{c}") + max(cast("{c}" is null as int)) as bigint) as n_distinct from book"""
        for c in VIEW_COLUMNS
    ]))


def _sketch_columns(text: bool) -> list[str]:
    kept = VIEW_COLUMNS if text else NUMERIC_BOOK
    return [c for c in kept if c not in KEY_COLUMNS + ["grade"]]


def _sketched_moments() -> str:
    """Text columns have their missing counts alone."""
    parts = []
    for c in _sketch_columns(text=True):
        number = c in NUMERIC_BOOK or c in PERCENT_COLUMNS
        least, mean, most = (
            rnd(f'{f}(cast("{c}" as double))') if number else "cast(null as double)" for f in ("min", "avg", "max")
        )
        parts.append(f"""select '{c}' as "column", {least} as "min", {mean} as mean, {most} as "max",
 count(*) - count("{c}") as n_null from book""")
    return _book(_union(parts))


def _sketched_ranks() -> str:
    shares = ", ".join(f"({d(s)})" for s in SHARES)
    return _book(_union([
        f"""select '{c}' as "column", share, (select count("{c}") from book) as n, true as within
from (values {shares}) s(share) where (select count("{c}") from book) > 0"""
        for c in NUMERIC_BOOK + [c for c in PERCENT_COLUMNS if c not in NUMERIC_BOOK] if c not in KEY_COLUMNS
    ]))


def _within(columns: Sequence[str]) -> str:
    return _book(_union([
        f"""select '{c}' as "column",
 cast(count(distinct "{c}") + max(cast("{c}" is null as int)) as bigint) as n_distinct, true as within from book"""
        for c in columns
    ]))


def _missing(planted: bool) -> str:
    parts = []
    for c in VIEW_COLUMNS:
        nan = f"count(*) filter (id % {NAN_EVERY[c]} = 0)" if planted and c in NAN_EVERY else "0"
        null = f'count(*) filter ("{c}" is null and not id % {NAN_EVERY[c]} = 0)' if nan != "0" else f'count(*) - count("{c}")'
        parts.append(f"""select '{c}' as "column", {null} as n_null, cast({nan} as bigint) as n_nan,
 {rnd(f'({null} + {nan}) / cast(count(*) as double)')} as frac_missing from loans""")
    return _loans(_union(parts))


def _inferred() -> str:
    """Counts of what each column was made of."""
    n = {
        "x_flag": ("id % 11 <> 0", "true", "false", "false", "logical"),
        "x_whole": ("id % 13 <> 0", "false", "true", "true", "integer"),
        "x_long": ("true", "false", "false", "true", "double"),
        "x_amount": ("true", "false", "false", "true", "double"),
        "x_mixed": ("true", "false", "id % 97 <> 3", "id % 97 <> 3", "text"),
        "x_letter": ("true", "false", "false", "false", "text"),
        "x_empty": ("false", "false", "false", "false", "logical"),
    }
    return _loans(_union([
        f"""select '{c}' as "column", count(*) filter ({filled}) as filled, count(*) filter ({filled} and {lg}) as n_logical,
 count(*) filter ({filled} and {whole}) as n_integer, count(*) filter ({filled} and {num}) as n_number, '{kind}' as "type" from loans"""
        for c, (filled, lg, whole, num, kind) in n.items()
    ]))


def _typed_unknown() -> str:
    raw = ", ".join(f"{sql} as {c}" for c, sql in UNKNOWN_COLUMNS.items())
    return _loans(f"""select id, case x_flag when 'TRUE' then true when 'false' then false end as x_flag,
 try_cast(x_whole as bigint) as x_whole, cast(x_long as double) as x_long,
 {rnd("case when x_amount <> 'NaN' then cast(x_amount as double) end")} as x_amount, x_mixed, x_letter,
 cast(null as boolean) as x_empty from (select id, {raw} from loans)""")


def _lines(select: str) -> str:
    return _loans(f"""{select} from (select *, id || ',' || loan_status || ',' || purpose as fields from loans)""")


def _std() -> str:
    return _book(_union([
        f"""select '{c}' as "column", {rnd(f'case when count("{c}") = count(*) then stddev_samp(cast("{c}" as double)) end', 4)} as std
from book""" for c in NUMERIC_BOOK if c not in KEY_COLUMNS
    ]))


def _class_means() -> str:
    def one(c: str, value: str, strict: bool) -> str:
        mean = f'avg(cast("{c}" as double))'
        if strict:
            mean = f'case when count("{c}") = count(*) then {mean} end'
        return f"(select {rnd(mean)} from ratio_book where loan_status = '{value}')"

    return _ratio_book(_union([
        f"""select '{c}' as "column", {one(c, 'Fully Paid', s)} as mean_paid,
 {one(c, 'Default', s)} as mean_default"""
        for names, s in ((STRICT_CLASS_MEANS, True), (CLASS_MEANS, False)) for c in names
    ]))


def _histogram(source: str, value: str, breaks: Sequence[float]) -> str:
    bins = ", ".join(
        f"({i}, {d(lo)}, {d(hi)})" for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]), 1)
    )
    low, high = d(breaks[0]), d(breaks[-1])
    return f"""select b.bin, b.lower, b.upper, count(s.v) as "count"
from (values {bins}) b(bin, lower, upper)
left join (select {value} as v from {source}) s
 on (s.v > b.lower or (b.bin = 1 and s.v = b.lower)) and s.v <= b.upper
group by 1, 2, 3
union all select 0, cast(null as double), {low}, count(*) from (select {value} as v from {source}) where v < {low}
union all select {len(breaks)}, {high}, cast(null as double), count(*) from (select {value} as v from {source}) where v > {high}"""


def _default_histogram(source: str, value: str) -> str:
    """Round breaks of 1, 2, 5 or 10 times a power of ten for about 1 + log2(n) bins."""
    return f"""v as materialized (select cast({value} as double) as v from {source} where {value} is not null),
size as (select min(v) as low, max(v) as high, (max(v) - min(v)) / ceil(log2(count(*)) + 1) as cell from v),
base as (select *, pow(10.0::double, floor(log10(cell))) as b from size),
s1 as (select *, case when 2 * b - cell < 1.5 * (cell - b) then 2 * b else b end as s from base),
s2 as (select * replace (case when 5 * b - cell < 2.75 * (cell - s) then 5 * b else s end as s) from s1),
s3 as (select * replace (case when 10 * b - cell < 1.5 * (cell - s) then 10 * b else s end as s) from s2),
edges as (select unnest(generate_series(floor(low / s + 1e-7)::bigint, ceil(high / s - 1e-7)::bigint)) as i, s from s3),
bins as (select cast(row_number() over (order by i) as int) as bin, round(i * s, 6) as lower, round((i + 1) * s, 6) as upper
 from edges where i < (select max(i) from edges))
select bin, lower, upper, (select count(*) from v where (v > lower or (bin = 1 and v = lower)) and v <= upper) as "count"
from bins"""


DOUBLES = ["dti", "funded_amnt", "annual_inc", "revol_bal", "recoveries", "total_rec_prncp",
           "avg_cur_bal", "bc_open_to_buy", "acc_now_delinq"]


def _shape() -> str:
    def sample(c: str) -> str:
        shown = f'cast("{c}" as varchar)'
        if c in TEXT_COLUMNS + PERCENT_COLUMNS:
            shown = f"""'"' || "{c}" || '"'"""
        elif c in DOUBLES:
            shown = f'cast(cast(round("{c}", 4) as decimal(38, 4)) as varchar)'
        return f"(select string_agg(coalesce({shown}, 'NA'), ', ' order by id) from (select * from loans order by id limit 4))"

    rows = ", ".join(
        f"""{{'position': {i}, 'column': '{c}', 'type': case typeof(max("{c}")) when 'VARCHAR' then 'character'
 when 'DOUBLE' then 'numeric' else 'integer' end, 'n_rows': count(*), 'sample': any_value({sample(c)})}}"""
        for i, c in enumerate(VIEW_COLUMNS, 1)
    )
    return _loans(f"select unnest([{rows}], recursive := true) from loans")


def _preview() -> str:
    columns = ", ".join(f'{rnd(c)} as "{c}"' if c in DOUBLES else f'"{c}"' for c in VIEW_COLUMNS)
    return _loans(f"select {columns} from loans order by id limit 6")


def _csv() -> str:
    def column(c: str) -> str:
        if c in KEY_COLUMNS:
            return f'cast("{c}" as bigint) as "{c}"'
        if c in TEXT_COLUMNS + PERCENT_COLUMNS:
            return f'"{c}"'
        return f"""{rnd(f'cast("{c}" as double)')} as "{c}\""""

    return _loans(f"select {', '.join(map(column, VIEW_COLUMNS))} from loans")


def _names(columns: Sequence[str], source: str) -> str:
    rows = ", ".join(f"('{c}')" for c in columns)
    return _book(
        f'select "column", (select count(*) from {source}) as n_rows from (values {rows}) v("column")'
    )


DROPPED = DROP_UNUSED + DROP_OBSERVED + DROP_REVIEWED


def _mean_filled(c: str) -> str:
    return f'coalesce(cast("{c}" as double), (select avg(cast("{c}" as double)) from ratio_book))'


def _imputed() -> str:
    columns = ", ".join(f'{rnd(_mean_filled(c))} as "{c}"' for c in IMPUTED_COLUMNS)
    return _ratio_book(f"select id, {columns} from ratio_book")


def _prepared_columns() -> list[str]:
    # Over half null, or without variation, in the loan view.
    by_data = ["mths_since_last_record", "application_type", "policy_code",
               "verification_status_joint"]
    return [c for c in VIEW_COLUMNS if c not in DROPPED + by_data + ["id", "loan_status"]]


def _prepared_value(c: str) -> str:
    if c in IMPUTED_COLUMNS:
        return _mean_filled(c)
    return f'"{c}"' if c in TEXT_COLUMNS else f'cast("{c}" as double)'


def _prepared() -> str:
    columns = ["id", "cast(cast(loan_status like '%Paid%' as int) as double) as loan_status"]
    for c in _prepared_columns():
        value = _prepared_value(c)
        columns.append(f'{value if c in TEXT_COLUMNS else rnd(value)} as "{c}"')
    return _ratio_book(f"select {', '.join(columns)} from ratio_book")


def _prepared_table() -> str:
    columns = ", ".join(f'{_prepared_value(c)} as "{c}"' for c in _prepared_columns())
    return f"""prepared as materialized (
 select id, cast(loan_status like '%Paid%' as int) as y, {columns} from ratio_book
)"""


# -- associations -----------------------------------------------------------


def _corr(a: str, b: str) -> str:
    r = f"corr(cast({a} as double), cast({b} as double))"
    return f"case when isfinite({r}) then {r} end"


def _pairs(strict: bool) -> str:
    parts = []
    for a, b in CORRELATION_PAIRS:
        x, y = (
            (_mean_filled(c).replace("ratio_book", "book") if strict and c in IMPUTED_COLUMNS else c)
            for c in (a, b)
        )
        r = _corr("x", "y")
        if strict:
            r = f"case when count(x) = count(*) and count(y) = count(*) then {r} end"
        parts.append(
            f"select '{a}' as var_a, '{b}' as var_b, {rnd(r)} as r from (select {x} as x, {y} as y from book)"
        )
    return _book(_union(parts))


def _matrix(where: str = "") -> str:
    numeric = [c for c in _prepared_columns() if c not in TEXT_COLUMNS]
    complete = " and ".join(f"{c} is not null" for c in numeric)
    cells = ", ".join(
        f"{{'var_a': '{a}', 'var_b': '{b}', 'r': {rnd(_corr(a, b))}}}" for a in numeric for b in numeric
    )
    return (
        _with(LOANS, BOOK, RATIO_BOOK, _prepared_table(),
              f"complete as materialized (select * from prepared where {complete})")
        + f"\nselect * from (select unnest([{cells}], recursive := true) from complete) {where}"
    )


PROTECTED = PREDICTORS + LOSS_INPUTS


def _pruning() -> str:
    """Common table expressions up to gone (c, by, r): columns visited by worth, kept without a strong kept partner."""
    numeric = [c for c in _prepared_columns() if c not in TEXT_COLUMNS]
    complete = " and ".join(f"{c} is not null" for c in numeric)
    cells = ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'r': {_corr(a, b)}}}" for a in numeric for b in [*numeric, "y"]
    )
    first = ", ".join(f"'{c}'" for c in PROTECTED)
    return (
        _with(LOANS, BOOK, RATIO_BOOK, _prepared_table(),
              f"complete as materialized (select * from prepared where {complete})").replace("with ", "with recursive ", 1)
        + f""",
cells as materialized (select unnest([{cells}], recursive := true) from complete),
ranked as materialized (
 select a as c, a in ({first}) as protected, row_number() over (
  order by case when a in ({first}) then list_position([{first}], a) else 1000 end,
   r is null, round(abs(r), 9) desc, a) as k
 from cells where b = 'y'
),
partners as materialized (
 select k, c, protected, (select coalesce(list(b), []) from cells where a = c and b not in ('y', c) and round(abs(r), 9) >= {MIN_ABS_R}) as strong
 from ranked
),
walk(k, kept) as (
 select cast(0 as bigint), cast([] as varchar[])
 union all
 select p.k, case when p.protected or not list_has_any(w.kept, p.strong) then list_append(w.kept, p.c) else w.kept end
 from walk w join partners p on p.k = w.k + 1
),
finally as materialized (select kept from walk order by k desc limit 1),
gone as materialized (
 select p.c, arg_min(x.b, (-round(abs(x.r), 9), x.b)) as "by"
 from partners p join cells x on x.a = p.c and list_contains(p.strong, x.b) join ranked o on o.c = x.b and o.k < p.k, finally
 where not list_contains(kept, p.c) and list_contains(kept, x.b)
 group by p.c
)"""
    )


def _pruned() -> str:
    return _pruning() + f"""
select g.c as "column", g."by" as kept_column, {rnd('x.r')} as r from gone g join cells x on x.a = g.c and x.b = g."by"
"""


def _prepared_pruned() -> str:
    names = ", ".join(f"('{c}')" for c in ["id", "loan_status", *_prepared_columns()])
    return _pruning() + f"""
select "column", (select count(*) from book) as n_rows from (values {names}) v("column")
where "column" not in (select c from gone)
"""


def _screening_pairs() -> str:
    parts = []
    for a, b in CORRELATION_PAIRS:
        if {a, b} <= set(_prepared_columns()):
            r = f"case when count({a}) = count(*) and count({b}) = count(*) then {_corr(a, b)} end"
            parts.append(f"select '{a}' as var_a, '{b}' as var_b, {rnd(r)} as r from prepared")
    return _with(LOANS, BOOK, RATIO_BOOK, _prepared_table()) + "\n" + _union(parts)


def _bins(column: str, text: bool) -> str:
    if text:
        return f"select '{column}' as variable, cast({column} as varchar) as bin, y from t"
    deciles = f"(select list_distinct(quantile_disc(cast({column} as double), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) from t)"
    passed = f"len(list_filter({deciles}, lambda c: c <= cast({column} as double)))"
    return f"""select '{column}' as variable,
 case when {column} is not null then cast({passed} as varchar) end as bin, y from t"""


_WOE_BOOK = "t as materialized (select *, cast(loan_status like '%Paid%' as int) as y from book)"


def _woe(columns: dict[str, bool], final: str, *tables: str) -> str:
    rows = _union([_bins(c, text) for c, text in columns.items()])
    return _with(
        LOANS, BOOK, *(tables or [_WOE_BOOK]),
        f"""grouped as (select variable, bin, count(*) as n, cast(sum(y) as bigint) as n1,
  cast(count(*) - sum(y) as bigint) as n0 from ({rows}) group by variable, bin)""",
        """shares as (select *, n1 / cast(sum(n1) over (partition by variable) as double) as p1,
  n0 / cast(sum(n0) over (partition by variable) as double) as p0 from grouped)""",
        """woes as (select *, case when n1 > 0 and n0 > 0 then ln(p1 / p0) else 0 end as woe,
  case when n1 > 0 and n0 > 0 then (p1 - p0) * ln(p1 / p0) else 0 end as iv from shares)""",
    ) + "\n" + final


_WOE_ROWS = f"select variable, bin, n, n1, n0, {rnd('woe')} as woe, {rnd('iv')} as iv from woes"

# -- split ------------------------------------------------------------------


def _ranked(source: str, stratum: str) -> str:
    return f"""select *, row_number() over (partition by {stratum} order by md5('42:' || id))
  <= floor(0.7 * count(*) over (partition by {stratum}) + 0.5) as is_train from {source}"""


def _target_split(column: str) -> str:
    """The target's own values are the strata, unless more than half the rows are distinct."""
    return f"""select a.* replace (
  case when (select 2 * count(distinct {column}) > count(*) from defaults)
   then b.is_train else a.is_train end as is_train)
 from ({_ranked('defaults', column)}) a
 join (select id, is_train from ({_ranked('defaults', '1')})) b using (id)"""


# -- least squares ----------------------------------------------------------

# The fit with sub_grade levels, a 60-month flag, int_rate and dti. Centring on
# the sub_grade means removes the levels (Frisch-Waugh-Lovell), which leaves
# three normal equations; they are solved by Cramer's rule.


def _det(m: Sequence[Sequence[str]]) -> str:
    (a, b, c), (e, f, g), (h, i, j) = m
    return f"({a}*({f}*{j}-{g}*{i}) - {b}*({e}*{j}-{g}*{h}) + {c}*({e}*{i}-{f}*{h}))"


_S = [["tt", "tr", "td"], ["tr", "rr", "rd"], ["td", "rd", "dd"]]
_Y = ["ty", "ry", "dy"]


def _replaced(column: int) -> str:
    return _det([[_Y[r] if c == column else _S[r][c] for c in range(3)] for r in range(3)])


def _cofactor(r: int, c: int) -> str:
    rows = [i for i in range(3) if i != r]
    cols = [i for i in range(3) if i != c]
    minor = f"({_S[rows[0]][cols[0]]}*{_S[rows[1]][cols[1]]} - {_S[rows[0]][cols[1]]}*{_S[rows[1]][cols[0]]})"
    return f"({'-' if (r + c) % 2 else ''}{minor})"


def _ols(name: str, source: str, y: str) -> str:
    """Common table expressions {name}_slopes (one row) and {name}_levels (per sub_grade)."""
    inverse = ", ".join(
        f"{_cofactor(r, c)} / {_det(_S)} as i_{'trd'[r]}{'trd'[c]}" for r in range(3) for c in range(r, 3)
    )
    return f"""{name}_train as materialized (
 select sub_grade, cast(term = ' 60 months' as int)::double as t, int_rate as r, dti as d,
  cast({y} as double) as y from {source} where is_train
),
{name}_means as materialized (
 select sub_grade, count(*) as n, avg(t) as mt, avg(r) as mr, avg(d) as md, avg(y) as my
 from {name}_train group by sub_grade
),
{name}_sums as materialized (
 select sum((t-mt)*(t-mt)) as tt, sum((t-mt)*(r-mr)) as tr, sum((t-mt)*(d-md)) as td,
  sum((r-mr)*(r-mr)) as rr, sum((r-mr)*(d-md)) as rd, sum((d-md)*(d-md)) as dd,
  sum((t-mt)*(y-my)) as ty, sum((r-mr)*(y-my)) as ry, sum((d-md)*(y-my)) as dy,
  sum((y-my)*(y-my)) as yy
 from {name}_train join {name}_means using (sub_grade)
),
{name}_slopes as materialized (
 select {_replaced(0)} / {_det(_S)} as bt, {_replaced(1)} / {_det(_S)} as br,
  {_replaced(2)} / {_det(_S)} as bd, {inverse}, s.* from {name}_sums s
),
{name}_levels as materialized (
 select m.*, my - bt*mt - br*mr - bd*md as a from {name}_means m, {name}_slopes
),
{name}_stats as materialized (
 select (select count(*) from {name}_train) as n, 3 + (select count(*) - 1 from {name}_levels) as k,
  yy - bt*ty - br*ry - bd*dy as sse,
  (select sum((y - (select avg(y) from {name}_train)) ** 2) from {name}_train) as sst
 from {name}_slopes
)"""


def _predicted(name: str) -> str:
    return (
        f"((select a from {name}_levels l where l.sub_grade = b.sub_grade)"
        f" + {name}_slopes.bt * cast(b.term = ' 60 months' as int)"
        f" + {name}_slopes.br * b.int_rate + {name}_slopes.bd * b.dti)"
    )


SPLITS = {
    "pd": (f"pd_rows as materialized ({_ranked('targeted', 'y')})", "y"),
    "lgd": (f"lgd_rows as materialized ({_target_split('recovery_rate')})", "recovery_rate"),
    "ead": (f"ead_rows as materialized ({_target_split('ccf')})", "ccf"),
}


def _fitted(*names: str) -> str:
    parts = [LOANS, BOOK, TARGETED, DEFAULTS]
    for n in names:
        rows, y = SPLITS[n]
        parts += [rows, _ols(n, f"{n}_rows", y)]
    return _with(*parts)


def _moments(name: str) -> str:
    return _fitted(name) + "\n" + _union([
        f"select sub_grade as moment, {rnd('avg(y)', 7)} as value from {name}_train group by 1",
        f"select case when t = 1 then ' 60 months' else ' 36 months' end as moment, {rnd('avg(y)', 7)} as value from {name}_train group by 1",
        f"select 'int_rate' as moment, {rnd('sum(y*r)', 4)} as value from {name}_train",
        f"select 'dti' as moment, {rnd('sum(y*d)', 4)} as value from {name}_train",
    ])


def _coefficient_rows(name: str) -> str:
    """(term, estimate, v): v times the residual variance is the squared standard error."""

    def form(x: Sequence[str]) -> str:
        i = {0: "t", 1: "r", 2: "d"}
        return " + ".join(
            f"({x[r]})*({x[c]})*i_{i[min(r, c)]}{i[max(r, c)]}" for r in range(3) for c in range(3)
        )

    base = f"(select * from {name}_levels order by sub_grade limit 1)"
    own = form(["o.mt", "o.mr", "o.md"])
    diff = form(["l.mt - o.mt", "l.mr - o.mr", "l.md - o.md"])
    return _union([
        f"select '(Intercept)' as term, o.a as estimate, 1.0::double / o.n + {own} as v from {base} o, {name}_slopes",
        f"""select 'sub_grade' || l.sub_grade, l.a - o.a, 1.0::double / l.n + 1.0::double / o.n + {diff}
from {name}_levels l, {base} o, {name}_slopes where l.sub_grade <> o.sub_grade""",
        f"select 'term 60 months', bt, i_tt from {name}_slopes",
        f"select 'int_rate', br, i_rr from {name}_slopes",
        f"select 'dti', bd, i_dd from {name}_slopes",
    ])


def _coefficients(name: str) -> str:
    return _fitted(name) + f"""
select term, {rnd('estimate', 5)} as estimate, {rnd('sqrt(v * s2)', 5)} as std_error,
 {rnd('estimate / sqrt(v * s2)', 4)} as t_value
from ({_coefficient_rows(name)}) c, (select sse / (n - k - 1) as s2 from {name}_stats)"""


def _p_values(name: str) -> str:
    """Two-sided p-values: the t density integrated by Simpson's rule in 2,000 steps."""
    weight = "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"
    integral = f"1 - 2 * any_value(t) / 6000.0::double * sum({weight} * y)"
    density = "exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) * pow(1 + x * x / f, -(f + 1) / 2)"
    return _fitted(name) + f""",
t_values as (
 select term, least(abs(estimate / sqrt(v * s2)), 40) as t, f
 from ({_coefficient_rows(name)}) c,
  (select sse / (n - k - 1) as s2, cast(n - k - 1 as double) as f from {name}_stats)
),
points as (
 select term, t, f, i, t * i / 2000.0::double as x from t_values, (select unnest(generate_series(0, 2000)) as i)
)
select term, {rnd(integral, 5)} as p_value
from (select *, {density} as y from points) group by term"""


def _unseen_level() -> str:
    rows, y = SPLITS["pd"]
    seen = f"(select * from pd_rows where sub_grade <> '{UNSEEN_LEVEL}')"
    return _with(LOANS, BOOK, TARGETED, DEFAULTS, rows, _ols("pd", seen, y)) + f"""
select count(*) as n_loans, count(*) - count(p) as n_unscored, {rnd('avg(p)')} as mean_score
from (select {_predicted('pd')} as p from pd_rows b, pd_slopes)"""


def _many_levels(final: str) -> str:
    """The same equations with a level for one or two loans in the place of the sub-grade."""
    leveled = "leveled as materialized (select * replace ('v' || cast(floor(id / 5.0) as bigint) as sub_grade) from targeted)"
    rows = f"pd_rows as materialized ({_ranked('leveled', 'y')})"
    return _with(LOANS, BOOK, TARGETED, leveled, rows, _ols("pd", "pd_rows", "y")) + "\n" + final


_MANY_LEVEL_SLOPES = f"""select term, {rnd('estimate', 5)} as estimate, {rnd('sqrt(v * s2)', 5)} as std_error,
 {rnd('estimate / sqrt(v * s2)', 4)} as t_value
from ({_union([f"select '{t}' as term, b{k} as estimate, i_{k}{k} as v from pd_slopes"
               for t, k in (("term 60 months", "t"), ("int_rate", "r"), ("dti", "d"))])}) c,
 (select sse / (n - k - 1) as s2 from pd_stats)"""


def _stats(name: str) -> str:
    return _fitted(name) + f"""
select n, cast(k as int) as df_model, n - k - 1 as df_residual, {rnd('1 - sse/sst')} as r2,
 {rnd('1 - (sse/sst) * (n - 1) / (n - k - 1)')} as r2_adjusted,
 {rnd('((sst - sse) / k) / (sse / (n - k - 1))', 4)} as f_statistic,
 {rnd('sqrt(sse / (n - k - 1))')} as sigma, {rnd('sse / (n - k - 1)')} as dispersion,
 {rnd('sst', 4)} as null_deviance, {rnd('sse', 4)} as deviance,
 {rnd('n * (ln(2 * pi() * sse / n) + 1) + 2 * (k + 2)', 3)} as aic
from {name}_stats"""


def _residuals(name: str, condition: str) -> str:
    y = SPLITS[name][1]
    return f"""res as materialized (select b.{y} as y, {_predicted(name)} as p
 from {name}_rows b, {name}_slopes where {condition})"""


def _errors(name: str, condition: str) -> str:
    return _fitted(name) + ",\n" + _residuals(name, condition) + f"""
select {rnd('abs(avg(y - p))', 5)} as abs_mean_error, {rnd('sqrt(avg((y - p) * (y - p)))', 5)} as rmse
from res"""


def _trend(source: str, p: str, e: str, digits: int = 6) -> str:
    shares = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"
    cuts = f"(select list_distinct(quantile_disc({p}, {shares})) from {source})"
    return f"""select cast(len(list_filter({cuts}, lambda c: c <= {p})) as int) as bin, count(*) as n,
 {rnd(f'avg({p})', digits)} as mean_prediction, {rnd(f'avg(abs({e}))', digits)} as mean_abs_residual
from {source} group by 1"""


def _fitted_book(final: str) -> str:
    return _fitted("pd", "lgd", "ead") + f""",
scored as (
 select b.id, b.funded_amnt, {_predicted('pd')} as p_paid, {_predicted('lgd')} as recovery_rate,
  {_predicted('ead')} as ccf
 from targeted b, pd_slopes, lgd_slopes, ead_slopes
),
{_LOSS}
{final}"""


_LOSS = """el as (
 select *, 1 - recovery_rate as "LGD", ccf * funded_amnt as "EAD",
  case when p_paid > cast(0.62 as double) then 0 when p_paid is not null then 1 end as "PD",
  case when p_paid > cast(0.62 as double) then 0 when p_paid is not null then 1 end
   * (1 - recovery_rate) * (ccf * funded_amnt) as "EL"
 from scored
)"""


def _loss_rows(digits: int, amount_digits: int) -> str:
    return f"""select id, {rnd('p_paid', digits)} as p_paid, {rnd('recovery_rate', digits)} as recovery_rate,
 {rnd('ccf', digits)} as ccf, {rnd('"LGD"', digits)} as "LGD", {rnd('"EAD"', amount_digits)} as "EAD", "PD",
 {rnd('"EL"', amount_digits)} as "EL" from el"""


def _totals(strict: bool = True) -> str:
    void = 'case when count("EL") = count(*) then {} end' if strict else "{}"
    total, share = void.format('sum("EL")'), void.format('sum("EL") / sum(funded_amnt)')
    return f"""select {rnd(total, 4)} as total_el, {rnd(share, 9)} as el_share,
 count(*) as n_loans, count(*) - count("EL") as n_unscored from el"""


_P = (
    f"{d('1.0')} + case term when ' 36 months' then {d(0)} when ' 60 months' then {d(-0.05)} end"
    f" + {d(-0.03)} * int_rate + {d(-0.002)} * dti"
)


def _fixed_book(source: str, final: str) -> str:
    return _with(LOANS, BOOK, TARGETED, f"""scored as (
 select id, funded_amnt, {_P} as p_paid, {d(0.05)} + {d(0.01)} * int_rate + {d(0.001)} * dti as recovery_rate,
  {d(0.4)} + {d(0.002)} * int_rate + {d(0.005)} * dti as ccf from {source}
)""", _LOSS) + "\n" + final


def _fixed_scores(final: str) -> str:
    return _with(LOANS, BOOK, TARGETED, f"""s as materialized (
 select y, p, y - p as e, cast(p > {d(0.62)} as int) as c from (select y, {_P} as p from targeted)
)""") + "\n" + final


def _cells(source: str) -> str:
    return f"""select predicted, actual,
 (select count(*) from {source} s where s.c = predicted and s.y = actual) as "count"
from (values (0, 0), (0, 1), (1, 0), (1, 1)) v(predicted, actual)"""


def _pd_test(final: str) -> str:
    return _fitted("pd") + f""",
s as materialized (
 select y, cast({_predicted('pd')} > {d(0.62)} as int) as c
 from pd_rows b, pd_slopes where not is_train
)
{final}"""


# ---------------------------------------------------------------------------


# Queries that are asked again over the view with NaN in it.
NAN_QUERIES = [
    "null_profile", "column_summary", "std_by_column", "class_means", "impute_means", "imputed",
    "prepared_loans", "raw_ranges", "target_ranges", "histogram_dti", "histogram_dti_default_breaks",
    "mean_dti_by_term_strict", "distinct_values_dti", "distinct_counts", "corr_pairs_incomplete",
    "woe_dti", "csv_round_trip", "portfolio_loss_unscored",
]


def all_oracles() -> dict[str, str]:
    sql = {"default_rate_by_grade": _rate("grade", 100)}
    for key in [*SEGMENT_KEYS, "purpose"]:
        sql[f"default_rate_by_{key}"] = _rate(key)
    sql["default_rate_by_issue_m"] = _rate("issue_m", key_sql="split_part(issue_d, '-', 1)")
    sql["segment_report"] = _segment_report()
    sql["status_counts_raw"] = _loans(f'select loan_status, count(*) as "count" {_KEPT} group by 1')
    sql["status_counts_recoded"] = _book('select loan_status, count(*) as "count" from book group by 1')
    sql["issue_month_counts"] = _book(
        """select split_part(issue_d, '-', 1) as issue_m, count(*) as "count" from book group by 1"""
    )
    sql["default_counts_by_state"] = _book(
        "select addr_state, count(*) as default_count from book where loan_status = 'Default' group by 1"
    )
    for c in FREQUENCY_COLUMNS:
        sql[f"frequency_{c}"] = _frequency(c)
    sql["mean_rate_of_defaults_by_grade"] = _book(
        f"select grade, {rnd('avg(int_rate)')} as int_rate from book where loan_status = 'Default' group by 1"
    )
    sql["mean_dti_by_term_strict"] = _book(
        f"select term, {rnd('case when count(dti) = count(*) then avg(dti) end')} as dti from book group by 1"
    )
    sql["null_safe_left_join"] = _book("""select t.acc_now_delinq, t."count", f.default_count
from (select acc_now_delinq, count(*) as "count" from book group by 1) t
left join (select acc_now_delinq, count(*) as default_count from book
 where loan_status = 'Default' group by 1) f
 on t.acc_now_delinq is not distinct from f.acc_now_delinq""")

    sql["exclude_unresolved"] = _loans(f"select id, loan_status {_KEPT}")
    sql["recode_outcome"] = _loans(f"select id, {_OUTCOME} as outcome {_KEPT}")
    sql["binary_target"] = _loans(f"select id, cast(loan_status like '%Paid%' as int) as target {_KEPT}")
    sql["parse_percent"] = _loans(
        "select id, try_cast(replace(int_rate, '%', '') as double) as int_rate,"
        " try_cast(replace(revol_util, '%', '') as double) as revol_util from loans"
    )
    sql["issue_month"] = _loans("select id, split_part(issue_d, '-', 1) as issue_m from loans")
    sql["ratio_to_funded"] = _loans("select id, " + ", ".join(
        f"{rnd(f'cast({c} as double) / nullif(funded_amnt, 0)')} as {c}" for c in RATIO_COLUMNS
    ) + " from loans")
    sql["classify_threshold"] = _book(f"""select id,
 cast(case when p > {d(0.62)} then 1 when p is not null then 0 end as double) as predicted,
 cast(case when p > {d(0.62)} then 0 when p is not null then 1 end as double) as pd
from (select id, {_P} as p from book)""")
    sql["recovery_rate"] = _loans(
        f"select id, {rnd('case when recoveries / funded_amnt > 1 then 1 else recoveries / funded_amnt end')} as recovery_rate from loans"
    )
    sql["ccf"] = _loans(f"select id, {rnd('(funded_amnt - total_rec_prncp) / funded_amnt')} as ccf from loans")

    sql["shape"] = _shape()
    sql["preview"] = _preview()
    sql["text_summary"] = _loans(_union([
        f"""select '{c}' as "column", count(*) as "length", 'character' as "class",
 count(*) - count("{c}") as n_null from loans""" for c in VIEW_COLUMNS if c in TEXT_COLUMNS + PERCENT_COLUMNS
    ]))
    sql["column_summary"] = _summary()
    sql["null_profile"] = _nulls()
    sql["sparse_columns"] = _nulls("null_share > 0.5")
    sql["constant_columns"] = _constant()
    sql["kept_columns"] = _names([c for c in VIEW_COLUMNS if c not in DROPPED], "loans")
    sql["numeric_columns"] = _names(NUMERIC_BOOK, "book")
    sql["distinct_counts"] = _distinct_counts()
    for c in ("term", "desc", "dti"):
        sql[f"distinct_values_{c}"] = _book(f'select "{c}", min(id) as first_seen from book group by 1')
    sql["std_by_column"] = _std()
    sql["class_means"] = _class_means()
    sql["histogram_int_rate"] = _book(_histogram("book", "int_rate", RATE_BREAKS))
    sql["histogram_default_breaks"] = (
        _with(LOANS, BOOK) + ",\n" + _default_histogram("book", "int_rate")
    )
    sql["portfolio_profile_nulls"] = _nulls().replace("from book", "from ratio_book").replace(
        BOOK, f"{BOOK},\n{RATIO_BOOK}").replace("from ratio_book)", "from book)")
    sql["portfolio_profile_class_means"] = _class_means()
    sql["portfolio_profile_frequency_purpose"] = _frequency("purpose")
    sql["impute_means"] = _ratio_book(_union([
        f"""select '{c}' as "column", {rnd(f'avg(cast({c} as double))')} as mean from ratio_book"""
        for c in IMPUTED_COLUMNS
    ]))
    sql["imputed"] = _imputed()
    sql["prepared_loans"] = _prepared()
    sql["csv_round_trip"] = _csv()

    sql["corr_pairs"] = _pairs(strict=True)
    sql["corr_pairs_incomplete"] = _pairs(strict=False)
    sql["corr_matrix"] = _matrix()
    sql["correlated_pairs"] = _matrix(f"where var_a < var_b and abs(r) >= {MIN_ABS_R}")
    sql["woe_int_rate"] = _woe({"int_rate": False}, _WOE_ROWS)
    sql["woe_dti"] = _woe({"dti": False}, _WOE_ROWS)
    sql["woe_sub_grade"] = _woe({"sub_grade": True}, _WOE_ROWS)
    sql["information_value"] = _woe(
        {c: c in TEXT_COLUMNS for c in _prepared_columns()},
        f"select variable, {rnd('sum(iv)')} as iv from woes group by 1",
        RATIO_BOOK, _prepared_table(), "t as materialized (select * from prepared)",
    )
    sql["screening_pairs"] = _screening_pairs()
    sql["woe_many_levels"] = _woe(
        {"level": True}, _WOE_ROWS,
        "t as materialized (select 'v' || cast(floor(id / 28.0) as bigint) as level,"
        " cast(loan_status like '%Paid%' as int) as y from book)",
    )
    sql["many_strata_split"] = (
        _with(LOANS, BOOK, "strata as (select id, case when id % 3 = 0 then -1"
              " else cast(floor(id / 40.0) as bigint) end as stratum from book)")
        + f"\nselect id, stratum, is_train from ({_ranked('strata', 'stratum')})"
    )
    sql["quantiles_by_brackets"] = _book(_union([
        f"""select '{c}' as "column", {rnd(f'quantile_cont(cast({c} as double), 0.25)')} as q1,
 {rnd(f'quantile_cont(cast({c} as double), 0.5)')} as median,
 {rnd(f'quantile_cont(cast({c} as double), 0.75)')} as q3 from book"""
        for c in ("dti", "int_rate", "annual_inc", "open_rv_12m")
    ]))

    sql["stratified_split"] = (
        _with(LOANS, BOOK, TARGETED)
        + f"\nselect id, y as target, is_train from ({_ranked('targeted', 'y')})"
    )
    for name, column in (("recovery_split", "recovery_rate"), ("ccf_split", "ccf")):
        sql[name] = (
            _with(LOANS, BOOK, TARGETED, DEFAULTS)
            + f"\nselect id, is_train from ({_target_split(column)})"
        )
    sql["default_targets"] = (
        _with(LOANS, BOOK, TARGETED, DEFAULTS)
        + f"\nselect id, {rnd('recovery_rate')} as recovery_rate, {rnd('ccf')} as ccf from defaults"
    )
    sql["target_ranges"] = _with(LOANS, BOOK, TARGETED, DEFAULTS) + "\n" + _union([
        f"""select '{name}' as "column", {rnd(f'min({c})')} as "min", {rnd(f'max({c})')} as "max",
 count(*) - count({c}) as n_null from defaults"""
        for name, c in (("recovery_rate", "recovery_share"), ("ccf", "ccf"))
    ])

    for name in ("pd", "lgd", "ead"):
        sql[f"{name}_fit_moments"] = _moments(name)
        sql[f"{name}_coefficients"] = _coefficients(name)
        sql[f"{name}_fit_stats"] = _stats(name)
    for name in ("lgd", "ead"):
        sql[f"{name}_errors_train"] = _errors(name, "is_train")
        sql[f"{name}_errors_test"] = _errors(name, "not is_train")
        test = _fitted(name) + ",\n" + _residuals(name, "not is_train") + "\n"
        sql[f"{name}_residual_histogram"] = test + _histogram("res", "y - p", RESIDUAL_BREAKS)
        sql[f"{name}_residual_trend"] = test + _trend("res", "p", "y - p", 5)
        train = _fitted(name) + ",\n" + _residuals(name, "is_train") + "\n"
        sql[f"{name}_residual_histogram_train"] = train + _histogram("res", "y - p", RESIDUAL_BREAKS)
        sql[f"{name}_residual_trend_train"] = train + _trend("res", "p", "y - p", 5)
        sql[f"{name}_p_values"] = _p_values(name)
    sql["coefficient_p_values"] = _p_values("pd")
    sql["scores_of_unseen_level"] = _unseen_level()
    sql["many_level_slopes"] = _many_levels(_MANY_LEVEL_SLOPES)
    sql["many_level_scores"] = _many_levels(f"""select b.id, {rnd(
        "l.a + bt * cast(b.term = ' 60 months' as int) + br * b.int_rate + bd * b.dti")} as prediction
from pd_rows b left join pd_levels l on l.sub_grade = b.sub_grade, pd_slopes""")
    sql["many_level_fit_stats"] = _many_levels(f"""select n, cast(k as int) as df_model, n - k - 1 as df_residual,
 {rnd('1 - sse/sst', 5)} as r2, {rnd('sqrt(sse / (n - k - 1))', 5)} as sigma from pd_stats""")

    sql["confusion_fixed_score"] = _fixed_scores(_cells("s"))
    sql["accuracy_fixed_score"] = _fixed_scores(
        f"select {rnd('avg(cast(c = y as int))')} as accuracy from s"
    )
    sql["error_metrics_fixed_score"] = _fixed_scores(
        f"select {rnd('abs(avg(e))')} as abs_mean_error, {rnd('sqrt(avg(e * e))')} as rmse from s"
    )
    sql["residual_histogram_fixed_score"] = _fixed_scores(_histogram("s", "e", RESIDUAL_BREAKS))
    sql["residual_trend_fixed_score"] = _fixed_scores(_trend("s", "p", "e"))
    sql["expected_loss_fixed_score"] = _fixed_book("targeted", _loss_rows(6, 4))
    sql["portfolio_loss_fixed_score"] = _fixed_book("targeted", _totals())
    sql["portfolio_loss_unscored"] = _fixed_book("book", _totals(strict=False))
    sql["portfolio_loss_void"] = _fixed_book("book", _totals())
    sql["pd_test_confusion"] = _pd_test(_cells("s"))
    sql["pd_test_accuracy"] = _pd_test(f"select {rnd('avg(cast(c = y as int))')} as accuracy from s")
    sql["expected_loss_fitted"] = _fitted_book(_loss_rows(4, 2))
    sql["portfolio_loss_fitted"] = _fitted_book(_totals())

    sql["missing_counts"] = _missing(planted=False)
    sql["raw_ranges"] = _loans(_union([
        f"""select '{c}' as "column", {rnd(f'cast(min({c}) as double)')} as "min", {rnd(f'cast(max({c}) as double)')} as "max",
 count(*) - count({c}) as n_null from loans""" for c in NAN_EVERY
    ]))
    sql["histogram_dti"] = _loans(_histogram("loans", "dti", DTI_BREAKS))
    sql["histogram_dti_default_breaks"] = _with(LOANS) + ",\n" + _default_histogram("loans", "dti")
    sql["sketched_moments"] = _sketched_moments()
    sql["sketched_quantile_ranks"] = _sketched_ranks()
    sql["sketched_distinct_within"] = _within(_sketch_columns(text=True))
    sql["approximate_distinct_within"] = _within(VIEW_COLUMNS)
    sql["inferred_types"] = _inferred()
    sql["typed_unknown_columns"] = _typed_unknown()
    sql["quarantined_lines"] = _lines(
        "select case when id % 37 = 0 then fields else fields || ',1,2' end as line"
    ) + " where id % 37 = 0 or id % 41 = 0"
    sql["well_formed_loans"] = _lines(
        f"select id, loan_status, purpose, {rnd('cast(cast(dti as decimal(9,2)) as double)')} as dti"
    ) + " where not (id % 37 = 0 or id % 41 = 0)"
    sql["pruned_columns"] = _pruned()
    sql["prepared_pruned_columns"] = _prepared_pruned()
    for name in NAN_QUERIES:
        sql[f"nan_{name}"] = sql[name].replace(LOANS, NAN_LOANS)
    sql["nan_missing_counts"] = _missing(planted=True)
    return sql

"""Exact quantiles without gathering a column in one place.

The built-in exact percentile keeps every distinct value of a column in one
buffer. Here a mergeable sketch proposes a bracket around each wanted rank, a
count over the table tells on which side of the bracket's ends the rank lies,
and this repeats inside the bracket until few enough values are left to rank.
The counts are exact, so the result does not depend on the sketch. A column with
few values is ranked at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskbook.functions.text import double_literal, quoted
from riskbook.operators.batched import MAX_BUFFERS, column_aggregates
from riskbook.schema import columns_of_type

# Values of one bracket that are ranked together, by one task.
MAX_VALUES = 200_000
# Brackets counted by one aggregate, with four counts each.
MAX_COUNTED = MAX_BUFFERS // 4
# Brackets ranked in one pass.
MAX_BRACKETS = 40
SKETCH_ERROR = 1e-4


@dataclass(frozen=True)
class _Target:
    """The rank-th smallest value (from 0) among those strictly between low and high."""

    column: str
    position: int
    rank: int
    size: int
    low: float | None = None
    high: float | None = None

    def inside(self) -> str:
        value = quoted(self.column)
        kept = [f"{value} is not null"]
        if self.low is not None:
            kept.append(f"{value} > {double_literal(self.low)}")
        if self.high is not None:
            kept.append(f"{value} < {double_literal(self.high)}")
        return f"case when {' and '.join(kept)} then {value} end"


def _bracket_shares(t: _Target, error: float) -> list[float]:
    """Shares whose sketched values lie on either side of the target."""
    share = (t.rank + 0.5) / t.size
    return [max(0.0, share - 2 * error), min(1.0, share + 2 * error)]


def _narrow(df: DataFrame, targets: list[_Target], error: float) -> tuple[list[_Target], dict]:
    """Put each target into a smaller bracket, or find its value."""
    intervals = list(dict.fromkeys((t.column, t.low, t.high) for t in targets))
    sample = {(t.column, t.low, t.high): t for t in targets}
    probabilities = sorted({p for t in targets for p in _bracket_shares(t, error)})
    inner = df.selectExpr(*[f"{sample[k].inside()} as v{i}" for i, k in enumerate(intervals)])
    sketched = inner.approxQuantile(inner.columns, probabilities, error)
    at = {
        (k, p): v
        for k, values in zip(intervals, sketched)
        for p, v in zip(probabilities, values)
    }

    brackets = [tuple(at[(t.column, t.low, t.high), p] for p in _bracket_shares(t, error)) for t in targets]
    return _count_brackets(df, targets, brackets)


def _count_brackets(
    df: DataFrame, targets: list[_Target], brackets: list[tuple[float, float]]
) -> tuple[list[_Target], dict]:
    # Neighbouring ranks mostly share a bracket, which is counted once. Each batch is one
    # aggregate of few fields over few columns, and all of them are one job.
    spots = [(t.column, t.low, t.high, *bracket) for t, bracket in zip(targets, brackets)]
    distinct = {spot: t for spot, t in zip(spots, targets)}
    listed = list(distinct)
    parts = []
    for start in range(0, len(listed), MAX_COUNTED):
        counts, rows = [], []
        for i, spot in enumerate(listed[start : start + MAX_COUNTED], start):
            v = f"({distinct[spot].inside()})"
            lo, hi = map(double_literal, spot[-2:])
            counts += [
                f"count_if({v} < {lo}) as below_{i}",
                f"count_if({v} = {lo}) as lo_{i}",
                f"count_if({v} > {lo} and {v} < {hi}) as between_{i}",
                f"count_if({v} = {hi} and {v} > {lo}) as hi_{i}",
            ]
            rows.append(f"struct({i} as i, below_{i} as below, lo_{i} as lo, between_{i} as between, hi_{i} as hi)")
        parts.append(df.selectExpr(*counts).selectExpr(f"inline(array({', '.join(rows)}))"))
    counted = {listed[r["i"]]: r for r in reduce(DataFrame.unionAll, parts).collect()}

    open_targets, found = [], {}
    for t, spot, (lo, hi) in zip(targets, spots, brackets):
        rank = t.rank
        below, at_lo, between, at_hi = (counted[spot][part] for part in ("below", "lo", "between", "hi"))
        if rank < below:
            open_targets.append(replace(t, high=lo, size=below))
        elif rank < below + at_lo:
            found[t.column, t.position] = lo
        elif rank < below + at_lo + between:
            open_targets.append(
                replace(t, rank=rank - below - at_lo, size=between, low=lo, high=hi)
            )
        elif rank < below + at_lo + between + at_hi:
            found[t.column, t.position] = hi
        else:
            passed = below + at_lo + between + at_hi
            open_targets.append(replace(t, rank=rank - passed, size=t.size - passed, low=hi))
    return open_targets, found


def _finish(df: DataFrame, targets: list[_Target]) -> dict:
    """Values of targets whose brackets hold few values.

    Equal values are counted first, then each bracket is ranked by a window of
    its own; the brackets spread over the tasks.
    """
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.column, t.low, t.high), []).append(t)
    found = {}
    brackets = list(groups.values())
    for start in range(0, len(brackets), MAX_BRACKETS):
        part = brackets[start : start + MAX_BRACKETS]
        inner = df.selectExpr(*[f"{g[0].inside()} as v{i}" for i, g in enumerate(part)])
        values = inner.unpivot([], inner.columns, "bracket", "value").filter("value is not null")
        upto = Window.partitionBy("bracket").orderBy("value")
        running = values.groupBy("bracket", "value").count().withColumn(
            "upto", F.sum("count").over(upto)
        )
        wanted = df.sparkSession.createDataFrame(
            [(f"v{i}", t.rank, i, j) for i, g in enumerate(part) for j, t in enumerate(g)],
            "bracket string, rank bigint, i int, j int",
        )
        # As many rows as quantiles were asked for.
        hits = running.join(F.broadcast(wanted), "bracket").filter(
            "upto - count <= rank and rank < upto"
        )
        for row in hits.select("i", "j", "value").collect():
            t = part[row["i"]][row["j"]]
            found[t.column, t.position] = row["value"]
    return found


def order_statistics(
    df: DataFrame,
    sizes: dict[str, int],
    ranks: dict[str, Sequence[int]],
    max_values: int = MAX_VALUES,
    sketch_error: float = SKETCH_ERROR,
) -> dict[str, list[float]]:
    """The values at the given ranks (from 0) of each double column."""
    targets = [
        _Target(c, i, r, sizes[c]) for c, wanted in ranks.items() for i, r in enumerate(wanted)
    ]
    found: dict = {}
    while wide := [t for t in targets if t.size > max_values]:
        narrowed, done = _narrow(df, wide, sketch_error)
        targets = [t for t in targets if t.size <= max_values] + narrowed
        found |= done
    found |= _finish(df, targets)
    return {c: [found[c, i] for i in range(len(wanted))] for c, wanted in ranks.items()}


def as_numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """SQL for each column as double, NaN counting as missing."""
    whole = set(columns_of_type(df, "integer"))
    return {
        c: f"double({quoted(c)})" if c in whole else f"nullif(double({quoted(c)}), double('NaN'))"
        for c in columns
    }


def _as_doubles(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    numbers = as_numbers(df, columns)
    values = df.selectExpr(*[f"{sql} as {quoted(c)}" for c, sql in numbers.items()])
    counted = column_aggregates(values, columns, {"n": "count({c})"})
    return values, {r["column"]: r["n"] for r in counted.collect()}


def discrete_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[str],
    max_values: int = MAX_VALUES,
    sketch_error: float = SKETCH_ERROR,
) -> dict[str, list[float]]:
    """Smallest value with at least that share of the column at or below it.

    Shares are given as text ("0.1", "1/3") so that ranks are exact. A column
    without values gives an empty list.
    """
    values, sizes = _as_doubles(df, columns)
    ranks = {
        c: [max(0, math.ceil(Fraction(s) * n) - 1) for s in shares] if n else []
        for c, n in sizes.items()
    }
    return order_statistics(values, sizes, ranks, max_values, sketch_error)


def interpolated_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[str],
    max_values: int = MAX_VALUES,
    sketch_error: float = SKETCH_ERROR,
) -> dict[str, list[float | None]]:
    """Quantiles that interpolate between the two neighbouring values."""
    values, sizes = _as_doubles(df, columns)
    spots = {c: [Fraction(s) * (n - 1) for s in shares] if n else [] for c, n in sizes.items()}
    ranks = {c: [r for p in ps for r in (math.floor(p), math.ceil(p))] for c, ps in spots.items()}
    ends = order_statistics(values, sizes, ranks, max_values, sketch_error)

    def between(low: float, high: float, part: Fraction) -> float:
        # Equal ends may be infinite, where a difference is none.
        return low if low == high or not part else low + float(part) * (high - low)

    return {
        c: [between(ends[c][2 * i], ends[c][2 * i + 1], p - math.floor(p)) for i, p in enumerate(ps)]
        or [None] * len(shares)
        for c, ps in spots.items()
    }

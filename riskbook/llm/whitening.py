"""Whiten embeddings along their principal components, by incremental eigendecomposition.

1. Every task reads its rows once and keeps the eigendecomposition of their scatter about their
   running mean. A row d away from the mean of the m rows before it adds m/(m+1) d d', a
   rank-one update: in the eigenbasis the new values are the roots of a secular equation, one
   between each pair of old ones, and the new vectors follow from the roots. Entries that the
   update doesn't reach, and directions of equal value (rotated until only one is reached), are
   deflated: they stay as they are.
2. Spectra are combined in a tree of fan-in ``FAN_IN``: a spectrum is added to another one by as
   many rank-one updates as it has directions, and one for the distance of the means.
3. Rayleigh-Ritz refinement: one pass multiplies the covariance by the leading vectors; the
   small projected problem is solved, residuals are divided by the gaps of the spectrum and
   taken off, until they are down to rounding.

Entries become integers first, so counts, sums and deviations are exact. A task holds a few
matrices of d x d, whatever its number of rows; the driver one spectrum. An update takes about
d^3 operations, which fits embeddings of some hundred entries.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are
dropped, as are rows of another length than most have; repeated rows and null ids count and
return as any other; other columns are not read. Components without spread (eigenvalue zero up
to rounding) have whitened null and stay out of the identity error; without any spread at all
explained and identity error are null. A deviation beyond a long is null. An empty table has no
rows. There are as many components as entries at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .workspace import Workspace

EPS = np.finfo(float).eps
#: Spectra that one task combines.
FAN_IN = 16
#: Vectors refined beyond the wanted components, and passes of refinement at most.
GUARD, PASSES = 8, 5


# -- rank-one updates --------------------------------------------------------


@lru_cache(maxsize=64)
def _upper(k: int) -> np.ndarray:
    return np.triu(np.ones((k, k)))


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> np.ndarray:
    """poles[j] - root[i] for the roots of 1 + rho * sum(weights / (poles - x)) = 0, all at once.

    Poles ascend and differ, weights are positive and sum to 1, rho is positive: one root
    follows each pole. Roots are sought as distances from the nearer pole, so differences keep
    their digits. A step fits two rational terms at the neighbouring poles; one that leaves the
    bracket is replaced by halving.
    """
    k = len(poles)
    after = np.append(poles[1:], poles[-1] + rho)  # the last root lies below that
    gap = after - poles
    level = 1.0 / rho
    column = weights[:, None]
    # from the sign in the middle of the interval, the half that holds the root
    middle = level + (column / ((poles[:, None] - poles) - gap / 2)).sum(0)
    right = middle < 0
    right[-1] = False  # no pole there
    origin = np.where(right, after, poles)
    shift = poles[:, None] - origin
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    x = (low + high) / 2
    upper = _upper(k)  # poles at or before the root's own
    first = poles - origin
    second = after - origin
    for _ in range(80):
        delta = shift - x
        terms = column / delta
        value = level + terms.sum(0)
        # terms before the root are negative, those after it positive
        head = np.einsum("ji,ji->i", terms, upper)
        open_ = (np.abs(value) > 8 * EPS * (value - 2 * head)) & (high - low > 2 * EPS * np.abs(x))
        if not open_.any():
            break
        low = np.where(value < 0, x, low)
        high = np.where(value > 0, x, high)
        slopes = terms / delta
        before = np.einsum("ji,ji->i", slopes, upper)
        total = slopes.sum(0)
        d1, d2 = first - x, second - x
        c = value - d1 * before - d2 * (total - before)
        a = (d1 + d2) * value - d1 * d2 * total
        b = d1 * d2 * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = x + step
        fits = (moved > low) & (moved < high)
        x = np.where(open_, np.where(fits, moved, (low + high) / 2), x)
    return shift - x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of ``basis diag(values) basis' + rho v v'``, rho > 0."""
    z = basis.T @ v
    length = math.sqrt(z @ z)
    strength = rho * length * length
    if not strength > 0:
        return values, basis
    z = z / length
    tol = 8 * EPS * max(abs(values[0]), abs(values[-1]), strength)
    live = np.flatnonzero(strength * np.abs(z) > tol)
    if not len(live):  # less than rounding
        return values, basis
    near = np.diff(values[live]) * np.abs(z[live[:-1]] * z[live[1:]]) <= tol * (z[live[:-1]] ** 2 + z[live[1:]] ** 2)
    if near.any():
        values, basis, z, live = _rotate_equal(values.copy(), basis.copy(), z, live, tol)
    poles, part = values[live], z[live]
    weights = part * part
    weights /= weights.sum()
    values, basis = values.copy(), basis.copy()
    if len(live) == 1:
        values[live] = poles + strength
    else:
        delta = secular_roots(poles, weights, strength)
        # the weights for which the computed roots are exact: vectors made of them are orthogonal
        span = poles - poles[:, None]
        k = len(poles)
        beneath = np.empty((k, k))
        beneath[:, :-1] = np.where(np.arange(k - 1) < np.arange(k)[:, None], span[:, :-1], span[:, 1:])
        beneath[:, -1] = 1.0
        exact = np.sqrt(np.prod(-delta / beneath, axis=1))
        turn = (np.copysign(exact, part)[:, None]) / delta
        turn /= np.sqrt((turn * turn).sum(0))
        values[live] = poles[0] - delta[0]
        basis[:, live] = basis[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def _rotate_equal(values, basis, z, live, tol):
    """Turn pairs of directions of (nearly) equal value until the update reaches one of each."""
    z = z.copy()
    kept: list[int] = []
    for j in live:
        if kept:
            i = kept[-1]
            r = math.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((values[j] - values[i]) * c * s) <= tol:
                z[i], z[j] = 0.0, r
                lower, higher = basis[:, i].copy(), basis[:, j].copy()
                basis[:, i], basis[:, j] = c * lower - s * higher, s * lower + c * higher
                a, b = values[i], values[j]
                values[i], values[j] = a * c * c + b * s * s, a * s * s + b * c * c
                kept.pop()
        kept.append(int(j))
    order = np.argsort(values, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return values[order], basis[:, order], z[order], np.sort(place[kept])


@dataclass
class Spectrum:
    """Number, mean and decomposed scatter of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        away = other.mean - self.mean
        for value, direction in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, direction, float(value))
        if self.n:
            weight = self.n * (other.n / (self.n + other.n))
            self.values, self.basis = rank_one(self.values, self.basis, away, weight)
        self.n += other.n
        self.mean = self.mean + away * (other.n / self.n)


# -- passes ------------------------------------------------------------------

_SPECTRUM = pa.schema([
    ("task", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())),
    ("eigenvalues", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64())),
])
_SPECTRUM_DDL = (
    "task long, n long, sums array<long>, mean array<double>, eigenvalues array<double>, basis array<double>"
)


def _spectrum_row(task: int, found: Spectrum, sums: np.ndarray) -> pa.RecordBatch:
    row = {
        "task": task, "n": found.n, "sums": sums.tolist(), "mean": found.mean.tolist(),
        "eigenvalues": found.values.tolist(), "basis": found.basis.reshape(-1).tolist(),
    }
    return pa.RecordBatch.from_pylist([row], _SPECTRUM)


def _local_spectra(dim: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = Spectrum.empty(dim), np.zeros(dim, np.int64)
        for batch in batches:
            rows = vectors.matrix(batch.column("x"), dim)
            sums += rows.sum(0)
            for row in (rows - offset).astype(float):
                found.add(row)
        if found.n:
            yield _spectrum_row(TaskContext.get().partitionId(), found, sums)

    return run


def _merge_spectra(dim: int):
    def run(rows: pa.Table) -> pa.Table:
        found, sums = Spectrum.empty(dim), np.zeros(dim, np.int64)
        rows = sorted(rows.to_pylist(), key=lambda r: r["task"])
        for r in rows:
            part = Spectrum(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["basis"]).reshape(dim, dim))
            found.merge(part)
            sums += np.array(r["sums"], np.int64)
        return pa.Table.from_batches([_spectrum_row(rows[0]["task"] // FAN_IN, found, sums)])

    return run


def whole_spectrum(x: DataFrame, dim: int, offset: int, work: Workspace) -> tuple[Spectrum, list[int]]:
    """Spectrum and sums of all rows of (x); the spectrum's mean leaves ``offset`` out."""
    parts = work.save(x.select("x").mapInArrow(_local_spectra(dim, offset), _SPECTRUM_DDL), "spectra-0")
    # tasks are numbered anew without gaps, so that each round has a FAN_INth of the last one's rows
    step, left = 0, parts.count()
    if not left:
        return Spectrum.empty(dim), [0] * dim
    while left > 1:
        step += 1
        merged = parts.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(_merge_spectra(dim), _SPECTRUM_DDL)
        parts = work.save(merged, f"spectra-{step}")
        work.drop(f"spectra-{step - 1}")
        left = parts.count()
    r = parts.first()
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["basis"]).reshape(dim, dim)), r["sums"]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n without losing digits to the size of x."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole) - rest


def covariance_times(x: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The covariance of all rows times ``basis``, and the trace in an extra last row."""
    dim, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace, seen = np.zeros((dim, k)), 0.0, False
        for batch in batches:
            rows = _centred(vectors.matrix(batch.column("x"), dim), n, sums)
            total += rows.T @ (rows @ basis)
            trace += float((rows * rows).sum())
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([vectors.lists(np.append(total.reshape(-1), trace)[None])], ["part"])

    parts = x.select("x").mapInArrow(run, "part array<double>")
    cells = parts.select(F.posexplode("part").alias("cell", "value")).groupBy("cell").agg(F.sum("value").alias("value"))
    found = np.zeros(dim * k + 1)
    for r in cells.collect():
        found[r["cell"]] = r["value"]
    return found / n


@dataclass
class Whitening:
    """What whitening needs of the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray  # one a column
    trace: float


def refine(x: DataFrame, found: Spectrum, sums: list[int], components: int) -> Whitening:
    """Leading components of the covariance, by Rayleigh-Ritz passes from the combined spectrum."""
    dim, n = len(sums), found.n
    k, wanted = min(dim, components + GUARD), min(dim, components)
    order = np.argsort(-found.values, kind="stable")
    spectrum, everything = found.values[order] / n, found.basis[:, order]
    basis, last = np.linalg.qr(everything[:, :k])[0], math.inf
    for _ in range(PASSES):
        product = covariance_times(x, n, sums, basis)
        image, trace = product[:-1].reshape(dim, k), float(product[-1])
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residual = image - basis * ritz
        error = float(np.abs(residual[:, :wanted]).max())
        if error <= 4 * EPS * max(ritz[0], 0.0) or error > last / 2:
            break
        last = error
        # along the directions outside the block, a residual over its gap is the error's first order
        outside = everything[:, k:]
        gaps = ritz[None, :] - spectrum[k:, None]
        along = outside.T @ residual
        correction = np.where(np.abs(gaps) > 1e-8 * ritz[0], along / np.where(gaps == 0, 1.0, gaps), 0.0)
        basis = np.linalg.qr(basis + outside @ correction)[0]
    return Whitening(n, list(sums), ritz[:wanted], basis[:, :wanted], trace)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - sums)^2 by row; None beyond a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    away = x - whole
    most = (int(np.abs(away).max(initial=0)) + 1) * n
    if most * most * len(sums) < 2**63:
        return ((n * away - rest) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in away]
    return [d if d < 2**63 else None for d in exact]


def fit_list(table: DataFrame, id_column: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): usable rows with integer entries ``floor(scale * c) + offset``."""
    kept = table.where(vectors.usable(F.col(vector)))
    entry = lambda c: F.floor(c.cast("double") * float(scale)) + F.lit(offset).cast("long")
    return kept.select(F.col(id_column).alias("vec_id"), F.transform(vector, entry).alias("x"))


def whiten(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) by row and component."""
    spark = table.sparkSession
    work = Workspace(spark, "whitening")
    x = work.save(fit_list(table, id_column, vector, scale, offset), "x")
    dim = vectors.common_length(x, "x")
    x = x.where(F.size("x") == dim)
    found, sums = whole_spectrum(x, dim, offset, work)
    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found.n:
        return spark.createDataFrame([], schema)
    fit = refine(x, found, sums, components)
    spread = fit.values > dim * EPS * max(fit.values[0], 0.0)
    divide = np.where(spread, np.sqrt(np.where(spread, fit.values, 1.0)), np.nan)
    n = fit.n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch.column("x"), dim)
            white = _centred(rows, n, fit.sums) @ fit.components / divide
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(_deviations(rows, n, fit.sums), pa.int64()), vectors.lists(white)],
                ["vec_id", "deviation", "white"],
            )

    id_type = x.schema["vec_id"].dataType.simpleString()
    white = work.save(x.mapInArrow(project, f"vec_id {id_type}, deviation long, white array<double>"), "white")
    error = identity_error(white, [i for i, s in enumerate(spread) if s])
    explained = fit.values / fit.trace if fit.trace > 0 else np.full(len(fit.values), np.nan)
    shares = F.array(*[F.lit(float(v)) for v in explained])
    work.keep_only("white")
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "value")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.nanvl("value", F.lit(None)).alias("whitened"),
        F.nanvl(shares[F.col("at")], F.lit(None)).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(white: DataFrame, at: list[int]) -> float | None:
    """Largest distance of the covariance of the given entries from the identity's; None without any."""
    if not at:
        return None
    means = white.agg(*[F.avg(F.col("white")[i]).alias(f"m{i}") for i in at]).first()
    pairs = [(i, j) for i in at for j in at if i <= j]
    centred = {i: F.col("white")[i] - F.lit(means[f"m{i}"]) for i in at}
    row = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

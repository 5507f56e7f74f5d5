import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbook.llm import whitening
from riskbook.llm.shipping import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def brute(vectors):
    """n, deviations, leading eigenpairs and trace, by the definition."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], basis[:, ::-1], values.sum()


def check(out, ids, vectors, components=8):
    n, deviation, centred, values, basis, trace = brute(vectors)
    k = min(components, centred.shape[1])
    assert len(out) == n * k
    at = {i: p for p, i in enumerate(ids)}
    white = np.full((n, k), np.nan)
    for r in out:
        assert (r["n"], r["deviation"]) == (n, deviation[at[r["vec_id"]]])
        white[at[r["vec_id"]], r["component"] - 1] = np.nan if r["whitened"] is None else r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9, abs=1e-12)
        assert r["identity_error"] < 1e-9
    for i in range(k):
        if values[i] > 1e-9 * values[0]:
            wanted = centred @ basis[:, i] / math.sqrt(values[i])
            sign = math.copysign(1, wanted @ white[:, i])
            np.testing.assert_allclose(sign * white[:, i], wanted, rtol=1e-7, atol=1e-8)
        else:
            assert np.isnan(white[:, i]).all()


def run(frame_, **more):
    return whitening.whiten(frame_, **more).collect()


def test_against_the_definition(frame, spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(600, 12)) @ rng.normal(size=(12, 12)) / 8).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    for parts in (1, 40):  # one spectrum; a tree of more than one level
        check(run(frame(rows, SCHEMA).repartition(parts)), range(600), vectors)


def test_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    check(run(table), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_unusable_rows_go_and_others_stay(frame):
    inf, nan = float("inf"), float("nan")
    good = [[0.5, 0.25], [1.0, -1.0], [0.0, 0.5], [0.5, 0.25]]
    bad = [None, [], [0.1, None], [nan, 0.0], [0.0, -inf], [1.0], [None, None]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(10 + i, v, 1) for i, v in enumerate(bad)]
    out = run(frame(rows, SCHEMA))
    check(out, range(4), np.array(good, np.float32))


def test_no_spread_few_rows_and_empty(frame):
    same = run(frame([(i, [0.5, 0.5, 0.25], 1) for i in range(5)], SCHEMA))
    assert len(same) == 15
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}
    one = run(frame([(None, [0.5, 0.1], None)], SCHEMA))
    assert [(r["vec_id"], r["n"]) for r in one] == [(None, 1)] * 2
    empty = whitening.whiten(frame([], SCHEMA))
    assert empty.count() == 0 and "identity_error" in empty.columns
    # a line in three dimensions: two components have no spread
    line = np.array([[i / 8, i / 4, -i / 8] for i in range(30)], np.float32)
    check(run(frame([(i, v.tolist(), 1) for i, v in enumerate(line)], SCHEMA)), range(30), line)


def test_names_of_its_own_columns_do_not_clash(frame):
    rows = [(i, [i / 7, (i * i % 5) / 3], 1.0, "c") for i in range(9)]
    table = frame(rows, "vec_id long, embedding array<double>, n double, whitened string")
    check(run(table), range(9), [r[1] for r in rows])


def test_rank_one_updates_keep_the_decomposition():
    rng = np.random.default_rng(1)
    cases = [
        np.zeros((3, 4)), np.ones((20, 3)), np.repeat(np.eye(5), 10, 0), rng.integers(0, 2, (300, 9)).astype(float),
        np.floor(rng.normal(size=(200, 3)) * 9) @ rng.integers(-2, 3, (3, 8)).astype(float),
        rng.normal(size=(500, 16)) * np.logspace(-6, 6, 16),
    ]
    for rows in cases:
        dim = rows.shape[1]
        whole, left, right = (whitening.Spectrum.empty(dim) for _ in range(3))
        for i, row in enumerate(rows):
            whole.add(row)
            (left if i < len(rows) // 3 else right).add(row)
        left.merge(right)
        away = rows - rows.mean(0)
        scatter = away.T @ away
        scale = max(np.abs(scatter).max(), 1.0)
        for s in (whole, left):
            assert np.abs(s.basis.T @ s.basis - np.eye(dim)).max() < 1e-12
            assert np.abs(s.basis * s.values @ s.basis.T - scatter).max() < 1e-11 * scale
            assert np.abs(np.sort(s.values) - np.linalg.eigvalsh(scatter)).max() < 1e-11 * scale


def test_large_counts_have_exact_deviations():
    n, sums = 3_000_000_000, [300_000_000_000_001, 7]
    x = np.array([[100_001, 2], [99_999, 0]], np.int64)
    wanted = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == [w if w < 2**63 else None for w in wanted]
    assert whitening._deviations(x, 3, [300_000, 3]) == [9 + 9, 9 + 9]


def test_usable_is_never_null(frame):
    from riskbook.llm.vectors import usable

    rows = frame([(1, None), (2, [None]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [r["u"] for r in rows.orderBy("vec_id").select(usable(F.col("embedding")).alias("u")).collect()] == [False, False, True]

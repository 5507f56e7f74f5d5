import hashlib
import math

import numpy as np
import pytest

from riskbook.llm import vector_codes
from riskbook.llm.shipping import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def brute(rows, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error, label_error)} and the digest, comparing everything with everything."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * float(np.float32(c))) for c in r[1]]))
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in r[1]] for r in rows], np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].copy()
    for k in range(rounds + 1):
        far = ((x[:, None] - books[None]) ** 2).sum(3)
        near = far.argmin(1)
        if k < rounds:
            for p in range(parts):
                for e in range(len(books)):
                    mine = x[near[:, p] == e, p]
                    if len(mine):
                        books[e, p] = [int(s) // len(mine) for s in mine.sum(0)]
    error = np.take_along_axis(far, near[:, None], 1)[:, 0].sum(1)
    labels = {}
    for r, e in zip(rows, error):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    flat = ",".join(str(int(c)) for p in range(parts) for b in books for c in b[p])
    out = sorted((r[0], "".join(f"{c:02x}" for c in n), int(e), labels[r[2]]) for r, n, e in zip(rows, near, error))
    return out, hashlib.sha256(flat.encode()).hexdigest()


def run(table):
    rows = vector_codes.codes(table).collect()
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), {r["codebooks_sha256"] for r in rows}


def check(frame, rows, parts=3):
    found, digests = run(frame(rows, SCHEMA).repartition(parts))
    wanted, digest = brute(rows)
    assert found == wanted and digests == {digest}


def test_against_all_comparisons(frame):
    rng = np.random.default_rng(5)
    rows = [(i * 7 % 1009, rng.normal(size=16).tolist(), i % 3 if i % 5 else None) for i in range(900)]
    check(frame, rows)


def test_ties_and_copies(frame):
    rng = np.random.default_rng(6)
    # few different values: many equal distances, many unused entries
    rows = [(i, rng.integers(0, 3, 8).astype(float).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, [1.0] * 8, 2) for i in range(400)]
    check(frame, rows, 5)


def test_fewer_rows_than_entries(frame):
    check(frame, [(i, [i / 2, -i / 4, 0.0, i * i / 9], None) for i in range(5)])


def test_unusable_rows_go(frame):
    good = [(1, [0.1, 0.2, 0.3, 0.4], 1), (2, [0.5, 0.2, 0.3, 0.4], None), (2, [0.5, 0.2, 0.1, 0.4], None)]
    nan, inf = float("nan"), float("inf")
    bad = [(3, None, 1), (4, [], 1), (5, [0.1, None, 0.2, 0.3], 1), (6, [nan] * 4, 1), (7, [inf, 0.0, 0.0, 0.0], 1), (8, [0.1], 1)]
    found, digests = run(frame(good + bad, SCHEMA))
    wanted, digest = brute(good)
    assert found == wanted and digests == {digest}


def test_null_id_empty_and_clashes(frame):
    out = vector_codes.codes(frame([(None, [0.5] * 4, 1), (1, [0.25] * 4, 1)], SCHEMA)).collect()
    assert sorted((r["code"], r["error"]) for r in out) == [("00000000", 0), ("01010101", 0)]
    assert vector_codes.codes(frame([], SCHEMA)).count() == 0
    named = frame([(i, [i / 3] * 4, i % 2, "s", 1.0) for i in range(6)], f"{SCHEMA}, code string, far double")
    assert run(named)[0] == brute([(i, [i / 3] * 4, i % 2) for i in range(6)])[0]


def test_limits_are_errors(frame):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.codes(frame([(1, [0.1] * 5, 1)], SCHEMA))
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.codes(frame([(1, [1e30] * 4, 1)], SCHEMA))
    with pytest.raises(ValueError, match="one byte"):
        vector_codes.compress(frame([], SCHEMA), entries=300)


def test_active_entries_give_what_all_entries_give():
    rng = np.random.default_rng(8)
    for top, large in ((4, 0), (50, 0), (50, vector_codes.SMALL)):
        x = rng.integers(0, top, (500, 3)).astype(np.int64) + large
        book = rng.integers(0, top, (20, 3)).astype(np.int64) + large
        code, far = vector_codes.assign(x, book, np.ones(20, bool), np.full(500, -1, np.int32), np.zeros(500, np.int64))
        active = rng.random(20) < 0.3
        book = book + np.where(active[:, None], rng.integers(-3, 4, (20, 3)), 0)
        code, far = vector_codes.assign(x, book, active, code, far)
        all_ = ((x[:, None] - book) ** 2).sum(2)
        assert (code == all_.argmin(1)).all() and (far == all_.min(1)).all()

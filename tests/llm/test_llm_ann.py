import math

import numpy as np
from pyspark.sql import functions as F

from riskbook.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i, tuple(np.float32(v).astype(float).tolist())] = None
    sizes = [len(v) for _, v in good]
    dim = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    good = [(i, v) for i, v in good if len(v) == dim]
    out = set()
    for q, a in good:
        if is_query(q):
            best = {(i, s) for i, b in good if i != q for s in [sum_in_order(a, b)]}
            out |= {(q, r, i, s) for r, (i, s) in enumerate(sorted(best, key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def found(df, k=5, **options):
    rows = ann.nearest(df, F.col("vec_id") % 4 == 0, k, orders=ann.Orders(curves=2, block=16), **options).collect()
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows}


def test_exact_with_copies_lengths_and_bad_vectors(frame):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(150)]  # one vector with many ids
    rows += [(2000, None), (2004, [0.0] * 6), (2008, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2012, [float("nan")] * 6), (2016, [1.0, 2.0])]
    rows += [(2020, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (2024, []), (8, [9.0] * 6), rows[0], rows[0]]
    got = found(frame(rows, SCHEMA))
    assert got == brute(rows, lambda q: q % 4 == 0, 5)


def test_ties_of_different_vectors_go_to_smaller_ids(frame):
    rng = np.random.default_rng(2)
    ids = rng.permutation(400)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, rng.integers(0, 2, (400, 10)))]
    rows += [(None, [1.0] * 10)] * 3 + [(None, [1.0] * 9 + [2.0])]
    assert found(frame(rows, SCHEMA)) == brute([r for r in rows if r[0] is not None], lambda q: q % 4 == 0, 5)


def test_one_id_with_many_vectors(frame):
    rng = np.random.default_rng(3)
    rows = [(8, [9.0, float(i)]) for i in range(30)] + [(9, [8.0, float(i % 15)]) for i in range(30)]
    rows += [(100 + i, rng.uniform(0, 8, 2).astype(np.float32).tolist()) for i in range(60)]
    assert found(frame(rows, SCHEMA)) == brute(rows, lambda q: q % 4 == 0, 5)


def test_fewer_candidates_than_asked(frame):
    rows = [(0, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0])]
    assert found(frame(rows, SCHEMA)) == brute(rows, lambda q: q % 4 == 0, 5)


def test_one_vector_and_none(frame):
    assert found(frame([(0, [1.0])], SCHEMA)) == set()
    assert found(frame([], SCHEMA)) == set()


def test_windows_alone_find_neighbours_on_a_curve(frame):
    rows = [(i, [math.cos(i / 100), math.sin(i / 100)]) for i in range(300)]
    near, right = found(frame(rows, SCHEMA), exact=False), found(frame(rows, SCHEMA))
    pairs = lambda s: {(q, v) for q, _, v, _ in s}
    assert len(pairs(near) & pairs(right)) >= 0.9 * len(right)


def test_hilbert_neighbours_are_one_step_apart():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = ann.hilbert_key(cells, 4)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(16**3))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()

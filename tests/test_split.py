import hashlib
import random
from collections import Counter

import pytest

from riskbook.operators import split


def expected(rows, seed=42):
    """Plain rank by hash within each stratum."""
    strata = {}
    for key, s in rows:
        strata.setdefault(s, []).append(key)
    train = set()
    for keys in strata.values():
        keys.sort(key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
        train |= set(keys[: (7 * len(keys) + 5) // 10])
    return train


def train_keys(df):
    return {r["id"] for r in df.filter("is_train").collect()}


ROWS = [(i, 0 if i % 3 else 1) for i in range(1500)] + [(i, None) for i in range(1500, 1545)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_as_rank_for_any_partitioning(frame, partitions):
    df = frame(ROWS, "id long, y int").repartition(partitions)
    out = split.stratified_split(df, "id", "y")
    assert train_keys(out) == expected(ROWS)
    assert out.count() == len(ROWS) and out.columns == ["id", "y", "is_train"]
    assert out.filter("is_train is null").count() == 0


def test_shares_round_half_up(frame):
    rows = [(i, n) for n in (1, 2, 5, 15) for i in range(100 * n, 100 * n + n)] + [
        (i, 0) for i in range(5000, 5030)
    ]
    out = split.stratified_split(frame(rows, "id long, y int"), "id", "y")
    counts = Counter(r["y"] for r in out.filter("is_train").collect())
    assert counts == {1: 1, 2: 1, 5: 4, 15: 11, 0: 21}


def test_nearly_unique_stratum_is_ignored(frame):
    rows = [(i, float(i if i % 4 else 0)) for i in range(200)]
    out = split.stratified_split(frame(rows, "id long, y double"), "id", "y")
    assert train_keys(out) == expected([(k, 0) for k, _ in rows])


def test_no_stratum_and_seed(frame):
    df = frame([(i,) for i in range(50)], "id long")
    assert train_keys(split.stratified_split(df, "id")) == expected([(i, 0) for i in range(50)])
    other = split.stratified_split(df, "id", seed=7)
    assert train_keys(other) == expected([(i, 0) for i in range(50)], seed=7)


def test_no_rows(frame):
    out = split.stratified_split(frame([], "id long, y int"), "id", "y")
    assert out.columns == ["id", "y", "is_train"] and out.count() == 0


def test_many_strata_with_a_hot_one(frame, monkeypatch):
    """A third of all rows in one stratum, which is broadcast; the others are shuffled."""
    monkeypatch.setattr(split, "HOT_SHARE", 5)
    rng = random.Random(3)
    rows = [(i, -1.0 if i % 3 == 0 else (None if i % 50 == 1 else float(rng.randrange(200)))) for i in range(2000)]
    out = split.stratified_split(frame(rows, "id long, y double"), "id", "y")
    assert train_keys(out) == expected(rows)
    assert out.count() == len(rows) and out.columns == ["id", "y", "is_train"]


def test_labelling_does_not_shuffle(frame):
    out = split.stratified_split(frame(ROWS, "id long, y int"), "id", "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan

import random

import numpy as np
import pytest

from riskbook.operators import quantiles
from riskbook.operators.batched import MAX_BUFFERS
from riskbook.operators.quantiles import discrete_quantiles, interpolated_quantiles

SHARES = ["0", "0.1", "0.25", "0.5", "0.75", "0.9", "1"]


def columns(n=3000):
    rng = random.Random(7)
    return {
        "smooth": [rng.gauss(0, 1) for _ in range(n)],
        "tied": [float(rng.choice([1, 1, 1, 1, 2, 3])) for _ in range(n)],
        "tailed": [rng.paretovariate(0.6) for _ in range(n)],
        "gaps": [rng.random() if i % 3 else None for i in range(n)],
        "hot": [0.0 if i % 3 else rng.random() - 0.5 for i in range(n)],
    }


@pytest.fixture(scope="module")
def table(frame):
    data = columns()
    return data, frame(
        list(zip(*data.values())), ", ".join(f"{c} double" for c in data)
    ).repartition(6)


# A large limit ranks the values at once, the small ones force the brackets.
@pytest.mark.parametrize("limits", [{}, {"max_values": 200, "sketch_error": 0.01},
                                    {"max_values": 5, "sketch_error": 0.05}])
def test_interpolated(table, limits):
    data, df = table
    found = interpolated_quantiles(df, list(data), SHARES, **limits)
    for c, values in data.items():
        kept = [v for v in values if v is not None]
        assert found[c] == pytest.approx(np.quantile(kept, [float(s) for s in SHARES])), c


@pytest.mark.parametrize("limits", [{}, {"max_values": 50, "sketch_error": 0.02}])
def test_discrete(table, limits):
    data, df = table
    found = discrete_quantiles(df, list(data), SHARES, **limits)
    for c, values in data.items():
        kept = sorted(v for v in values if v is not None)
        expected = [kept[max(0, -(-int(float(s) * 100) * len(kept) // 100) - 1)] for s in SHARES]
        assert found[c] == expected, c


def test_empty_and_single(frame):
    df = frame([(1.0, None)], "a double, b double")
    assert interpolated_quantiles(df, ["a", "b"], ["0.5"]) == {"a": [1.0], "b": [None]}
    assert discrete_quantiles(df, ["a", "b"], ["0.5"]) == {"a": [1.0], "b": []}


def test_nan_does_not_count(frame):
    df = frame([(1.0,), (float("nan"),), (3.0,)], "a double")
    assert interpolated_quantiles(df, ["a"], ["0.5"]) == {"a": [2.0]}


@pytest.mark.parametrize("limits", [{}, {"max_values": 2, "sketch_error": 0.05}])
def test_infinite_ends(frame, limits):
    inf = float("inf")
    df = frame([(1.0,), (2.0,), (inf,), (inf,)], "a double")
    assert interpolated_quantiles(df, ["a"], ["0", "0.9", "1"], **limits) == {"a": [1.0, inf, inf]}


def test_brackets_are_counted_by_aggregates_of_few_fields(table):
    assert quantiles.MAX_COUNTED * 4 <= MAX_BUFFERS
    data, df = table
    at = [quantiles._Target("smooth", i, r, 3000) for i, r in enumerate((10, 11, 1500))]
    opened, found = quantiles._count_brackets(df, at, [(-9.0, 0.0), (-9.0, 0.0), (-9.0, 0.0)])
    below = sum(v < 0 for v in data["smooth"])
    assert not found and [t.size for t in opened[:2]] == [below, below] and opened[2].rank in (1500, 1500 - below)

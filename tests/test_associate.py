import math

import numpy as np
import pytest

from riskbook.operators import associate

ROWS = [(1.0, 2.0, 5.0, 1), (2.0, 3.9, 5.0, 2), (3.0, None, 5.0, 3), (4.0, 8.3, 5.0, 1), (None, 1.0, 5.0, 2)]


@pytest.fixture(scope="module")
def df(frame):
    return frame(ROWS, "a double, b double, k double, i int")


def test_pairs_strict_and_pairwise(df):
    pairs = [("a", "b"), ("i", "i"), ("i", "k")]
    strict = [r["r"] for r in associate.pearson_pairs(df, pairs).collect()]
    assert strict[0] is None and strict[1] == pytest.approx(1.0) and strict[2] is None
    loose = associate.pearson_pairs(df, pairs, strict_nulls=False).first()["r"]
    assert loose == pytest.approx(np.corrcoef([1, 2, 4], [2, 3.9, 8.3])[0, 1])


def test_matrix_uses_complete_rows_only(df):
    m = {(r["var_a"], r["var_b"]): r["r"] for r in associate.correlation_matrix(df).collect()}
    assert m["a", "i"] == m["i", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 2, 1])[0, 1])
    assert m["a", "a"] == pytest.approx(1.0)
    assert m["a", "k"] is None and m["k", "k"] is None
    assert all(r is None or abs(r) <= 1 + 1e-12 for r in m.values())


def test_matrix_without_complete_rows(frame):
    m = associate.correlation_matrix(frame([(1.0, None), (None, 2.0)], "a double, b double"))
    assert [r["r"] for r in m.collect()] == [None] * 4


def test_correlated_pairs_once_each(df):
    matrix = associate.correlation_matrix(df, ["a", "b", "i"])
    assert [(r["var_a"], r["var_b"]) for r in associate.correlated_pairs(matrix, 0.9).collect()] == [("a", "b")]


def test_woe_levels_missing_and_one_sided(frame):
    rows = [("x", 1)] * 3 + [("x", 0)] + [("y", 0)] * 2 + [("y", 1)] + [(None, 0)] * 2 + [("z", 1), ("x", None)]
    woe = associate.woe_table(frame(rows, "c string, y int"), "y", ["c"])
    found = {r["bin"]: r for r in woe.collect()}
    assert {b: (r["n"], r["n1"], r["n0"]) for b, r in found.items()} == {
        "x": (4, 3, 1), "y": (3, 1, 2), None: (2, 0, 2), "z": (1, 1, 0),
    }
    assert found["x"]["woe"] == pytest.approx(math.log((3 / 5) / (1 / 5)))
    assert (found[None]["woe"], found[None]["iv"], found["z"]["iv"]) == (0.0, 0.0, 0.0)
    iv = associate.information_value(woe).first()["iv"]
    assert iv == pytest.approx(sum(r["iv"] for r in found.values())) and iv >= 0


def test_woe_numeric_bins(frame):
    rows = [(float(i), int(i % 3 == 0)) for i in range(100)] + [(None, 1)]
    found = {r["bin"]: r["n"] for r in associate.woe_table(frame(rows, "x double, y int"), "y", ["x"]).collect()}
    assert found == {"0": 9, **{str(i): 10 for i in range(1, 9)}, "9": 11, None: 1}


def test_woe_heavy_ties_merge_cuts(frame):
    rows = [(0.0, i % 2) for i in range(60)] + [(float(i), i % 2) for i in range(1, 41)]
    found = [r for r in associate.woe_table(frame(rows, "x double, y int"), "y", ["x"]).collect()]
    assert sum(r["n"] for r in found) == 100 and len(found) == 4


def test_woe_rates_text_with_any_number_of_levels(frame):
    rows = [(f"v{i}", f"w{i % 5}", i % 2) for i in range(1500)]
    woe = associate.woe_table(frame(rows, "many string, few string, y int"), "y", ["many", "few"])
    found = woe.collect()
    assert sum(r["variable"] == "many" for r in found) == 1500
    assert {r["variable"] for r in found} == {"many", "few"}
    assert all(r["woe"] == 0 for r in found if r["variable"] == "many")


def matrix_of(frame, strong, names, target="y"):
    """All cells of a matrix with the given correlations, others 0."""
    cells = {(a, b): 1.0 if a == b else 0.0 for a in [*names, target] for b in [*names, target]}
    for (a, b), r in strong.items():
        cells[a, b] = cells[b, a] = r
    return frame([(a, b, r) for (a, b), r in cells.items()], "var_a string, var_b string, r double")


def test_pruning_keeps_the_column_that_says_more(frame):
    strong = {("a", "b"): 0.9, ("b", "c"): -0.8, ("c", "d"): 0.2, ("a", "y"): 0.1, ("b", "y"): -0.5, ("c", "y"): 0.3}
    m = matrix_of(frame, strong, "abcd")
    order = associate.prune_order(m, "y")
    assert order == ["b", "c", "a", "d"]
    gone = {r["column"]: (r["kept_column"], r["r"]) for r in associate.prune_correlated(m, 0.7, order).collect()}
    assert gone == {"a": ("b", 0.9), "c": ("b", -0.8)}
    # nothing is strong at 0.95; the limit itself is strong
    assert associate.prune_correlated(m, 0.95, order).count() == 0
    assert associate.prune_correlated(m, 0.9, order).count() == 1


def test_a_chain_loses_only_what_a_kept_column_covers(frame):
    m = matrix_of(frame, {("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "y"): 0.3, ("b", "y"): 0.2, ("c", "y"): 0.1}, "abc")
    gone = [r["column"] for r in associate.prune_correlated(m, 0.5, associate.prune_order(m, "y")).collect()]
    assert gone == ["b"]  # c is strong with b alone, which goes


def test_protected_columns_stay_and_ties_go_by_name(frame):
    m = matrix_of(frame, {("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "y"): None, ("c", "y"): 0.2, ("b", "y"): 0.2}, "abc")
    assert associate.prune_order(m, "y") == ["b", "c", "a"]
    order = associate.prune_order(m, "y", ["c", "x"])
    assert order == ["c", "b", "a"]
    gone = {r["column"] for r in associate.prune_correlated(m, 0.5, ["c", "b", "a"], ["c", "b"]).collect()}
    assert gone == {"a"}

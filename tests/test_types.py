import pytest

from conftest import as_dict
from riskbook.sources import malformed_lines, read_loans
from riskbook.sources.types import infer_types

CASES = {
    "logical": ["T", "FALSE", "true", "NA", ""],
    "logical_not": ["T", "yes"],
    "whole": ["1", "-2", "+3", " 4 ", "NA"],
    "whole_and_logical": ["1", "T"],
    "long": ["1", "99999999999999999999"],
    "double": ["1", "2.5", "1e3", "NaN", "-Inf"],
    "letter": ["1d", "2"],
    "text": ["a", "1"],
    "nothing": ["", "NA"],
}
TYPES = {
    "logical": "logical", "logical_not": "text", "whole": "integer", "whole_and_logical": "text", "long": "double",
    "double": "double", "letter": "text", "text": "text", "nothing": "logical",
}


def table(frame):
    rows = max(map(len, CASES.values()))
    padded = [v + [None] * (rows - len(v)) for v in CASES.values()]
    return frame(list(zip(*padded)), ", ".join(f"{c} string" for c in CASES))


def test_least_type_of_each_column(frame):
    found = infer_types(table(frame), list(CASES))
    assert as_dict(found, "column", "type") == TYPES
    assert as_dict(found, "column", "filled")["whole"] == 4


def test_types_do_not_hang_on_partitions(frame):
    df = table(frame)
    key = lambda d: sorted(map(tuple, infer_types(d, list(CASES)).collect()))
    assert key(df.repartition(5)) == key(df.coalesce(1))
    assert {r["type"] for r in infer_types(df.limit(0), ["text"]).collect()} == {"logical"}


CSV = """id,flag,n,x,note
1,T,5,1.5,a
2,F,,NaN,b
3,NA,7,inf,
4,T,8,2
5,F,9,3,c,extra
6,T,10,4,"d,e"
"""


@pytest.fixture()
def path(tmp_path):
    (tmp_path / "l.csv").write_text(CSV)
    return str(tmp_path / "l.csv")


def test_values_of_each_type(spark, path):
    rows = {r["id"]: r for r in read_loans(spark, path).collect()}
    assert [rows[i]["flag"] for i in range(1, 7)] == [True, False, None, True, False, True]
    assert [rows[i]["n"] for i in range(1, 7)] == [5, None, 7, 8, 9, 10]
    assert [rows[i]["x"] for i in range(1, 4)] == [1.5, None, float("inf")]
    # a short row is filled up, a long one is cut
    assert rows[4]["note"] == "" and rows[5]["note"] == "c" and rows[6]["note"] == "d,e"


def test_malformed_rows_can_be_told_apart(spark, path):
    lines = {r["line"] for r in malformed_lines(spark, path).collect()}
    assert lines == {"4,T,8,2", "5,F,9,3,c,extra"}
    kept = read_loans(spark, path, drop_malformed=True)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 6]
    assert kept.columns == ["id", "flag", "n", "x", "note"] and kept.select("id").count() == 4


def test_file_without_header_and_clashing_name(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1,a\n2\n3,c\n")
    names = ["id", "malformed_line"]
    path = str(tmp_path / "n.csv")
    assert [r["line"] for r in malformed_lines(spark, path, names=names).collect()] == ["2"]
    assert read_loans(spark, path, names=names).count() == 3
    kept = read_loans(spark, path, names=names, drop_malformed=True)
    assert {(r["id"], r["malformed_line"]) for r in kept.collect()} == {(1, "a"), (3, "c")}

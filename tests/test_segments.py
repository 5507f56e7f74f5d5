from pyspark.sql import functions as F

from conftest import as_dict
from riskbook.operators import segments

ROWS = [
    ("A", "Fully Paid", 1.0), ("A", "Default", 2.0), ("A", "Default", 4.0),
    ("B", "Fully Paid", 3.0), (None, "Default", None), (None, "Default", 5.0),
]
SCHEMA = "grade string, loan_status string, int_rate double"


def test_rate_with_null_key_and_group_without_defaults(frame):
    rows = segments.segment_default_rate(frame(ROWS, SCHEMA), "grade", scale=100.0).collect()
    found = {r["grade"]: (r["count"], r["default_count"], r["default_rate"]) for r in rows}
    assert found[None] == (2, 2, 100.0)
    assert found["B"] == (1, None, None)
    assert found["A"][:2] == (3, 2) and abs(found["A"][2] - 200 / 3) < 1e-9


def test_same_as_left_join(frame):
    df = frame(ROWS, SCHEMA)
    joined = segments.left_join_null_safe(
        segments.count_by(df, "grade"), segments.default_counts(df, "grade"), "grade"
    )
    direct = segments.segment_default_rate(df, "grade").drop("default_rate")
    assert sorted(map(str, joined.collect())) == sorted(map(str, direct.collect()))


def test_report_over_many_keys(frame):
    df = frame(ROWS, SCHEMA).withColumn("flag", F.lit(1))
    rows = segments.segment_report(df, ["grade", "flag"]).collect()
    found = {(r["segment"], r["value"]): (r["count"], r["default_count"]) for r in rows}
    assert found == {
        ("grade", "A"): (3, 2), ("grade", "B"): (1, None), ("grade", None): (2, 2),
        ("flag", "1"): (6, 4),
    }


def test_one_shuffle_per_rate(frame):
    plan = segments.segment_default_rate(frame(ROWS, SCHEMA), "grade")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text


def test_counts_and_frequency(frame):
    df = frame(ROWS, SCHEMA)
    assert as_dict(segments.count_by(df, "grade"), "grade", "count") == {"A": 3, "B": 1, None: 2}
    assert as_dict(segments.frequency(df, "grade"), "grade", "count") == {"A": 3, "B": 1}
    assert as_dict(segments.default_counts(df, "grade"), "grade", "default_count") == {"A": 2, None: 2}


def test_mean_by_strict_and_lenient(frame):
    df = frame(ROWS, SCHEMA)
    where = F.col("loan_status") == "Default"
    strict = as_dict(segments.mean_by(df, "grade", "int_rate", where), "grade", "int_rate")
    assert strict == {"A": 3.0, None: None}
    lenient = segments.mean_by(df, "grade", "int_rate", where, strict_nulls=False)
    assert as_dict(lenient, "grade", "int_rate") == {"A": 3.0, None: 5.0}

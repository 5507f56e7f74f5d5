import os
import sys

import pytest
from pyspark.sql import types as T

import riskbook.sources.loan_view  # noqa: F401  (the package's own loan_view is the function)
from riskbook.sources import checkpoint_folder, read_loans, run_folder, stage, staging, write_scored
from riskbook.sources.types import typed

view = sys.modules["riskbook.sources.loan_view"]

CSV = '''id,loan_status,int_rate,dti,desc,extra,note,empty
1,Fully Paid, 13.5%,10.5,"said ""yes"", twice",1,a,
2,NA,,NA,"two
lines",2.5,NA,
3,"",5%,oops,,,,NA
4,Default,NA, 7 ,x,NA,7,
'''


@pytest.fixture()
def loans(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text(CSV)
    return {r["id"]: r for r in read_loans(spark, str(path), multi_line=True).collect()}


def test_blank_text_is_a_value_and_na_is_missing(loans):
    assert [loans[i]["loan_status"] for i in (1, 2, 3, 4)] == ["Fully Paid", None, "", "Default"]
    assert [loans[i]["int_rate"] for i in (1, 2, 3, 4)] == [" 13.5%", "", "5%", None]


def test_numbers(loans):
    assert [loans[i]["dti"] for i in (1, 2, 3, 4)] == [10.5, None, None, 7.0]


def test_quotes_and_line_breaks(loans):
    assert loans[1]["desc"] == 'said "yes", twice'
    assert loans[2]["desc"] == "two\nlines"


def test_unknown_columns_are_inferred(loans):
    assert [loans[i]["extra"] for i in (1, 2, 3, 4)] == [1.0, 2.5, None, None]
    assert [loans[i]["note"] for i in (1, 2, 3, 4)] == ["a", None, "", "7"]
    assert [loans[i]["empty"] for i in (1, 2, 3, 4)] == [None] * 4


def test_inference_can_be_left_out(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,extra\n1,2\n")
    df = read_loans(spark, str(tmp_path / "l.csv"), infer_unknown=False, multi_line=False)
    assert df.schema["extra"].dataType == T.StringType()
    assert df.schema["id"].dataType == T.LongType()


def test_stage_writes_below_the_configured_folder(spark, frame):
    staged = stage(frame([(1, "a"), (2, None)], "k int, v string"), "t")
    assert sorted(r["k"] for r in staged.collect()) == [1, 2]
    folder = checkpoint_folder(spark)
    assert folder == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert all(folder in f for f in staged.inputFiles())


def test_write_scored(spark, frame, tmp_path):
    write_scored(frame([(1, 0.5)], "id int, EL double"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["EL"] == 0.5


def test_nothing_is_left_of_a_run(spark, frame):
    with run_folder(spark) as folder:
        staged = stage(frame([(1,)], "k int"), "t")
        assert staged.count() == 1 and all(folder in f for f in staged.inputFiles())
    assert not os.path.exists(folder)


def test_wide_tables_are_staged_with_split_methods(spark, frame):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    wide = frame([tuple(range(30))], ", ".join(f"c{i} int" for i in range(30)))
    with staging.split_methods(wide):
        assert int(spark.conf.get(limit)) <= 8000
    assert spark.conf.get(limit) == before
    with staging.split_methods(wide.select("c0")):
        assert spark.conf.get(limit) == before


def test_more_tasks_make_the_view_of_larger_files(spark, sf_dir, monkeypatch):
    few = view.view_tasks(spark, sf_dir)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = view.loan_view(spark, sf_dir).select("id", "revol_bal").collect()
    monkeypatch.setattr(view, "TASK_BYTES", 1 << 12)
    assert view.view_tasks(spark, sf_dir) > 2 * few
    staged = stage(view.loan_view(spark, sf_dir).select("id", "revol_bal"), "view")
    assert len(staged.inputFiles()) > 2 * few
    assert sorted((r["id"], round(r["revol_bal"] or 0.0, 4)) for r in staged.collect()) == sorted(
        (r["id"], round(r["revol_bal"] or 0.0, 4)) for r in rows)


def test_numbers_are_cast_without_a_trimmed_copy(frame):
    texts = [" 7 ", "NA", " NA ", "", "  ", "1.5d", "2f ", "1.d", "-3.25", "1e3", "x", "NaN", None, "Infinity"]
    df = frame([(t,) for t in texts], "a string")
    got = [r[0] for r in df.select(typed("a", "double")).collect()]
    assert got == [7.0, None, None, None, None, None, None, None, -3.25, 1000.0, None, None, None, float("inf")]
    got = [r[0] for r in df.select(typed("a", "integer")).collect()]
    assert got[:5] == [7, None, None, None, None] and got[10:12] == [None, None]
    assert not any("trim" in str(typed("a", kind)) for kind in ("double", "integer"))

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from riskbook.operators import sketches


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(20_000).select(
        (F.col("id") % 7).alias("slice"),
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise((F.col("id") * 7919 % 10007).cast("double")).alias("x"),
        (F.col("id") % 3).cast("int").alias("i"),
        F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("t"), F.col("id") % 900)).alias("t"),
        F.lit(None).cast("double").alias("none"),
    )


def merged(df, **more):
    return sketches.merge_sketches(sketches.sketch_columns(df, ["x", "i", "t", "none"], ["slice"], **more))


def test_exact_parts_add_up_over_slices(df):
    rows = {r["column"]: r for r in sketches.sketched_summary(merged(df)).collect()}
    truth = df.where("not isnan(x)").agg(F.min("x"), F.avg("x"), F.max("x")).first()
    x = rows["x"]
    assert (x["min"], x["max"], x["n_null"]) == (truth[0], truth[2], 2000)
    assert x["mean"] == pytest.approx(truth[1])
    assert (rows["none"]["min"], rows["none"]["median"], rows["none"]["n_null"]) == (None, None, 20_000)
    assert rows["t"]["median"] is None and rows["i"]["median"] == 1.0


@pytest.mark.parametrize("k", [200, 2000])
def test_ranks_are_within_the_stated_error(df, k):
    found = sketches.sketched_quantiles(merged(df, k=k), [0.01, 0.5, 0.99]).where("column = 'x'").collect()
    ranks = sketches.ranks_of(df, {"x": [r["value"] for r in found]}).collect()
    at = {r["position"]: (r["below"], r["upto"]) for r in ranks}
    for i, r in enumerate(found):
        below, upto = at[i]
        assert below - sketches.rank_error(k) <= r["share"] <= upto + sketches.rank_error(k)


def test_distinct_counts_are_within_the_stated_error(df):
    found = as_dict(merged(df).select("column", sketches.distinct_estimate().alias("n")), "column", "n")
    exact = {c: df.select(F.nanvl(c, F.lit(None)) if c == "x" else c).distinct().count() for c in ("x", "i", "t", "none")}
    assert exact["t"] > 600 and found["i"] == 3 and found["none"] == 1
    assert all(abs(found[c] - n) <= sketches.distinct_error() * n for c, n in exact.items())


def test_merging_by_slice_and_empty_table(df):
    halves = sketches.sketch_columns(df, ["x"], ["slice", "i"])
    assert halves.count() == 21
    by_slice = sketches.merge_sketches(halves, ["slice"])
    assert by_slice.count() == 7 and by_slice.agg(F.sum("n")).first()[0] == 18_000
    assert sketches.merge_sketches(by_slice).count() == 1
    nothing = sketches.sketch_columns(df.limit(0), ["x", "t"])
    rows = sketches.sketched_summary(nothing).collect()
    assert {(r["column"], r["median"], r["n_distinct"]) for r in rows} == {("x", None, 0), ("t", None, 0)}
    assert sketches.sketched_quantiles(nothing, [0.5]).count() == 0


def test_ranks_are_counted_by_aggregates_of_few_fields(frame):
    names = [f"c{i}" for i in range(5)]
    df = frame([tuple(float(i + j) for j in range(5)) for i in range(10)], ", ".join(f"{c} double" for c in names))
    ranks = sketches.ranks_of(df, {c: [2.0, 3.0, 4.0, 5.0, 6.0] for c in names})
    assert ranks._jdf.queryExecution().logical().toString().count("Aggregate") == 3  # two columns each
    got = {(r["column"], r["position"]): (r["below"], r["upto"]) for r in ranks.collect()}
    assert got["c0", 0] == (0.2, 0.3) and got["c4", 4] == (0.2, 0.3) and len(got) == 25

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskbook.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def plan(docs, weights=(1.0,) * 8, **more):
    return [r.asDict() for r in sharding.plan_slots(docs, list(weights), **more).collect()]


def gapless(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_checksums_and_slots(frame):
    texts = ["", None, "a", "ä€", "x" * 300_000, "a\nb"]
    docs = frame([(i, t, "old") for i, t in enumerate(texts)], SCHEMA)
    rows = plan(docs)
    assert gapless(rows) and len(rows) == len(texts)
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = plan(docs)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 300 < sum(r["grown_shard"] == 8 for r in rows) < 600
    grown = {r["doc_id"]: r["shard"] for r in plan(docs, (1.0,) * 9)}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and all(400 < n < 600 for n in counts.values())


def test_weights_share_the_keys_and_move_few(spark):
    keys = spark.range(6000).select(F.col("id").alias("doc_id"))
    heavy = keys.select("doc_id", sharding.shard_of(F.col("doc_id"), [1.0, 2.0, 3.0]).alias("s"))
    counts = {r["s"]: r["count"] for r in heavy.groupBy("s").count().collect()}
    assert all(abs(counts[s] - 1000 * (s + 1)) < 150 for s in range(3))
    none = keys.select(sharding.shard_of(F.col("doc_id"), [1.0, 0.0, 1.0]).alias("s")).distinct().collect()
    assert {r["s"] for r in none} == {0, 2}
    # a higher weight of the last shard moves keys to it alone
    more = heavy.select("s", sharding.shard_of(F.col("doc_id"), [1.0, 2.0, 4.0]).alias("t"))
    assert more.where("s <> t and t <> 2").count() == 0


@pytest.mark.parametrize("weights", [[], [0.0], [1.0, -1.0], [float("inf")], [float("nan")]])
def test_wrong_weights_are_refused(weights):
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), weights)


def test_repeated_rows_null_keys_and_hot_keys(frame):
    rows = [(1, "same", None)] * 500 + [(None, f"t{i % 7}", None) for i in range(300)] + [(i, "same", None) for i in range(50)]
    out = plan(frame(rows, SCHEMA))
    assert gapless(out) and len(out) == len(rows)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1


def test_slots_dont_hang_on_the_ranges(spark, monkeypatch):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 10).alias("text"))
    key = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    few = key(plan(docs))
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1)
    assert key(plan(docs.repartition(5))) == few


def test_empty_table_text_keys_and_clashes(frame, spark, tmp_path):
    assert plan(frame([], SCHEMA)) == []
    assert gapless(plan(frame([("b", "t"), ("a", None)], "name string, text string"), key="name"))
    docs = frame([(i, f"t{i}", "old") for i in range(40)], SCHEMA)
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, [1.0])
    placed = sharding.assign_shards(docs, [1.0] * 4, column="to")
    assert placed.columns == ["doc_id", "text", "shard", "to"] and placed.count() == 40
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.drop("shard"), path, [1.0] * 4, files=2)
    back = spark.read.parquet(path)
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["to"]) for r in placed.collect()}

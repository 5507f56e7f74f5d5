"""Deal records to weighted shards by rendezvous hashing of their keys, with DataFrame functions only.

Every shard draws a number u in (0, 1) from a hash of (key, shard); the record goes to the shard
with the least -ln(u) / weight, ties to the lower number. A shard wins with a probability in
proportion to its weight. The draws of a shard don't hang on the others, so one more shard takes
records only into itself, a removed one gives up only its own, and a changed weight moves
records only to or from its shard. Choosing a shard is a projection: no shuffle, no state.

``slot`` numbers a shard's rows from 0 without gaps, in the order of a hash of (key, content). It
is found in two steps (sums of ranges of that hash, then rows within a range), so a shard of any
size is spread over many tasks. Rows alike in key and text are counted first and take
consecutive slots, so neither a hot key nor a hot copy gathers in one task: a key's different
texts lie in different ranges, and equal rows are one. The number of ranges follows the number
of rows and has no influence on the slots.

Defined cases: a null key counts as an empty one; a null text has no bytes and the checksum 0, as
an empty one; repeated rows keep a slot each; an empty table has no rows; other columns are
not looked at by ``plan_slots`` and kept by ``assign_shards``, whose new columns must have free
names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Hex digits of a draw: 52 bits, so that the middle of each step is a double.
DIGITS = 13
#: Rows (of different key or text) that a range of slots holds on average, at most.
RANGE_ROWS = 100_000


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draw(key: Column, shard: int) -> Column:
    """The shard's number in (0, 1) for a key."""
    digits = F.substring(F.md5(F.concat(key_text(key), F.lit(f":{shard}"))), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among shards 0, 1, ... of the given weights; weight 0 takes nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("weights must be finite, none below 0 and one above")
    races = [
        F.struct((-F.ln(draw(key, s)) / float(w)).alias("time"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*races) if len(races) > 1 else races[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", column: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row, without a shuffle."""
    if column in docs.columns:
        raise ValueError(f"docs has a column {column!r}; name another one")
    return docs.withColumn(column, shard_of(F.col(key), weights))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", files: int = 16) -> None:
    """Write ``docs`` as Parquet, one folder ``shard=...`` a shard and up to ``files`` files in each."""
    placed = assign_shards(docs, weights, key)
    # dealt by a hash of the whole row, so that a hot key's rows share no task
    part = F.pmod(F.xxhash64(*docs.columns), F.lit(files))
    dealt = placed.repartition(files * len(weights), "shard", part)
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)


def plan_slots(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``size`` is the text's bytes plus 1, ``grown_shard`` the shard among those of the weights
    ``grown`` (one more of the mean weight if not given).
    """
    work = Workspace(docs.sparkSession, "shards")
    grown = list(grown) if grown is not None else [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col(text), F.lit(""))
    # the one pass over the texts; rows alike in key and text become one with their number
    alike = (
        docs.select(
            F.col(key).alias("key"),
            F.octet_length(body).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body).alias("content"),
        )
        .groupBy("key", "size", "text_crc32", "content")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", shard_of(F.col("key"), weights))
        .withColumn("place", F.md5(F.concat(key_text(F.col("key")), F.lit(":"), F.col("content"))))
        .drop("content")
    )
    alike = work.save(alike, "alike")
    digits = max(1, math.ceil(math.log(max(2, alike.count() / RANGE_ROWS / len(weights)), 16)))
    ranged = alike.withColumn("range", F.substring("place", 1, digits))
    totals = ranged.groupBy("shard", "range").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    placed = ranged.join(offsets, ["shard", "range"]).withColumn("first", first)
    slots = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
    planned = placed.withColumn("slot", slots).select(
        F.col("key").alias(key),
        (F.col("size") + 1).alias("size"),
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("key"), grown).alias("grown_shard"),
    )
    out = work.save(planned, "slots")
    work.keep_only("slots")
    return out


def _race(shards: int) -> str:
    """The winner among equal shards: the largest draw."""
    draws = [f"{{'u': ('0x' || md5(k || ':{s}')[:{DIGITS}])::bigint, 's': {-s}}}" for s in range(shards)]
    return f"cast(-greatest({', '.join(draws)}).s as int)"


#: Eight equal shards of ``documents`` for DuckDB, which has no crc32: it is folded over the bytes.
SQL = f"""
with bits as (
  select unnest(range(256)) as byte
), steps(byte, k, crc) as (
  with recursive s(byte, k, crc) as (
    select byte, 0, byte from bits
    union all
    select byte, k + 1, case when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end from s where k < 8
  ) select byte, k, crc from s
), entries as (
  select list(crc order by byte) as entry from steps where k = 8
), texts as (
  select distinct coalesce(text, '') as body from documents
), sums as (
  select body, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda p: ('0x' || p)::bigint)),
    lambda crc, b: xor(crc >> 8, entry[xor(crc, b) % 256 + 1]))) as crc
  from texts, entries
), keyed as (
  select doc_id, coalesce(text, '') as body, coalesce(cast(doc_id as varchar), '') as k from documents
), dealt as (
  select *, {_race(8)} as shard, {_race(9)} as grown_shard, md5(k || ':' || md5(body)) as place from keyed
)
select d.doc_id, cast(strlen(d.body) + 1 as bigint) as size, cast(s.crc as bigint) as text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by place, doc_id nulls first) - 1 as slot, grown_shard
from dealt d join sums s on d.body = s.body
"""

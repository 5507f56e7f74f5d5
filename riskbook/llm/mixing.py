"""Mix sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source's documents are shuffled by a hash of their ids and queue up, several times over
if need be; a copy's virtual finish time is the words its source has sent up to its end,
divided by the source's target. All copies are then sorted by finish time, and the mix takes
them until the total budget is spent.

A source's target is its weight's share of the budget, at most ``MOST_COPIES`` times its size;
what is above is shared again by weight among the others. That ends where every target is
the smaller of its limit and weight times one common level, which is found directly.

Running sums are taken in two steps (sums of small buckets, then rows within a bucket), so a
source with a third of all rows is spread over ``BUCKETS`` tasks, and the global order over as
many ranges. The bounds of the ranges only balance the work: results don't hang on them.

Defined cases: a null or wordless text has size 0 and is never taken; a null source is a source
of its own, ordered last; a null id comes first in its bucket; repeated rows are queued each;
without any words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, free_name

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
#: Buckets of a source's shuffle (the first two hex digits of its hash), and ranges of the mix.
BUCKETS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    A source's weight goes round ``weights`` in code point order. With the sources sorted by
    limit / weight, those below the common level are a prefix of the order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    picks = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sources.withColumn("weight", picks[F.pmod(place, F.lit(len(weights))).cast("int")])
    limit = F.col("source_size") * float(MOST_COPIES)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    leveled = (
        weighted.withColumn("limit", limit)
        .withColumn("budget", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("budget") - spent) / F.sum("weight").over(onward))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    )
    # after the first source that is not filled up, levels fall: its own is the common one
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return leveled.withColumn("common", common).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def _running(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str) -> DataFrame:
    """Add ``running``: the sum of ``value`` up to each row, by (bucket, order) within its group."""
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("bucket_sum"))
    by_bucket = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = by_bucket.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, bucket, F.coalesce(F.sum("bucket_sum").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("inside", F.sum(value).over(inside))
        .join(offsets, [*groups, bucket])
        .withColumn("running", F.col("offset") + F.col("inside"))
        .drop("inside", "offset")
    )


def row_order(id_column: str, source: str, text: str) -> Column:
    """Number of a row among those with its id, alike wherever it is computed."""
    rows = Window.partitionBy(id_column).orderBy(F.col(source).asc_nulls_last(), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.row_number().over(rows)


def plan_mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, place, size, source_size, target, copies, taken) for every row of ``docs``.

    ``copies`` is how many times the mix takes the row, ``taken`` the words that makes, and
    ``place`` the row's ``row_order`` among rows of its id.
    """
    work = Workspace(docs.sparkSession, "mix")
    # the one pass over the texts; everything after it works on a few numbers a row
    read = work.save(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content"),
        ),
        "read",
    )
    by_id = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "content")
    # a null source gets a name that no other source has
    named = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    rows = read.select(
        "doc_id",
        named.alias("queue"),
        "size",
        F.row_number().over(by_id).alias("place"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffle"),
    ).withColumn("bucket", F.conv(F.substring("shuffle", 1, 2), 16, 10).cast("int"))
    rows = work.save(
        _running(rows, ["queue"], "bucket", [F.col("shuffle"), F.col("doc_id"), F.col("place")], "size"), "rows"
    )
    shares = targets(read.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    shares = work.save(shares.withColumn("queue", named).drop("source"), "targets")
    budget = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget")).first()["budget"]
    rows = rows.join(shares, "queue")

    finish = (F.col("epoch") * F.col("source_size") + F.col("running")).cast("double") / F.col("target")
    copies = work.save(
        rows.where((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1))))
        .select("doc_id", "place", "queue", "size", "shuffle", "epoch", finish.alias("finish")),
        "copies",
    )
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = copies.agg(F.percentile_approx("finish", steps, 10_000).alias("bounds")).first()["bounds"] or []
    ranges = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col("finish"))) if bounds else F.lit(0)
    order = [F.col(c) for c in ("finish", "queue", "epoch", "shuffle", "doc_id", "place")]
    sent = _running(copies.withColumn("range", ranges), [], "range", order, "size")
    taken = (
        sent.where(F.col("running") <= budget)
        .groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("copies"))
    )
    result = (
        rows.alias("r").join(
            taken.alias("t"),
            F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.place") == F.col("t.place")),
            "left",
        )
        .select("r.doc_id", "r.place", "r.size", "r.source_size", "r.target", F.coalesce("t.copies", F.lit(0)).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    out = work.save(result, "plan")
    work.keep_only("plan")
    return out


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it."""
    plan = plan_mix(docs, id_column, source, text, weights).where(F.col("copies") > 0)
    doc, at, place, copies, copy = (free_name(docs, f"_mix_{n}") for n in ("id", "at", "place", "copies", "copy"))
    plan = plan.select(F.col("doc_id").alias(doc), F.col("place").alias(at), F.col("copies").alias(copies))
    placed = docs.withColumn(place, row_order(id_column, source, text))
    chosen = placed.join(plan, placed[id_column].eqNullSafe(plan[doc]) & (placed[place] == plan[at]))
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


#: The plan of ``documents`` for DuckDB.
SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) as size,
         md5(cast(doc_id as varchar)) as shuffle,
         row_number() over (partition by doc_id order by source nulls last, md5(coalesce(text, ''))) as place
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighted as (
  select *, source_size * 3.0::double as cap,
         1.0::double + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sources
), leveled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last
               rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last
               rows between current row and unbounded following) as level
  from weighted
), shares as (
  select source, source_size,
         case when cap <= level * weight then cap
              else max(case when cap > level * weight then level end) over () * weight end as target
  from leveled
), queued as (
  select s.*, t.source_size, t.target,
         sum(size) over (partition by s.source order by shuffle, doc_id, place
                         rows between unbounded preceding and current row) as running
  from sized s join shares t on s.source is not distinct from t.source
), copies as (
  select doc_id, place, size, sum(size) over (
           order by cast(epoch * source_size + running as double) / target, source nulls last, epoch, shuffle, doc_id, place
           rows between unbounded preceding and current row) as sent
  from queued, (select unnest([0, 1, 2]) as epoch) where size > 0 and target > 0
), taken as (
  select doc_id, place, count(*) as copies from copies
  where sent <= (select sum(source_size) from sources) group by doc_id, place
)
select q.doc_id, cast(q.size as bigint) as size, q.source_size, q.target,
       cast(coalesce(t.copies, 0) * q.size as bigint) as taken
from queued q left join taken t on q.doc_id is not distinct from t.doc_id and q.place = t.place
"""

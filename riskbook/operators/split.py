"""Train/test split with an exact share of every stratum.

The rank order of a row is a hash of its key, so the result depends on neither
row order nor partitioning. Ranking every row would sort whole strata, one
task each, and there may be only two. Instead the hash at the quota is found
from counts per hash prefix, and rows are then labelled by comparing with it.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook.schema import SPLIT_SEED, TRAIN_RATIO
from riskbook.sources.staging import stage

# A stratum with more than this share of the rows is hot; there are fewer than
# HOT_SHARE of them.
HOT_SHARE = 1_000


def split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _prefix_digits(rows: int) -> int:
    """Hex digits such that prefixes, and rows per prefix, number about sqrt(rows)."""
    return min(8, max(1, math.ceil(math.log(max(rows, 2), 16) / 2)))


def _cuts(hashed: DataFrame, rows: int, ratio: str) -> DataFrame:
    """(stratum, n, cut): the largest training hash; strata with no training row are absent."""
    digits = _prefix_digits(rows)

    prefixed = hashed.withColumn("prefix", F.substring("hash", 1, digits))
    counts = prefixed.groupBy("stratum", "prefix").count()
    # At most 16^digits rows per stratum from here on.
    by_stratum = Window.partitionBy("stratum")
    running = counts.withColumns(
        {
            "n": F.sum("count").over(by_stratum),
            "upto": F.sum("count").over(by_stratum.orderBy("prefix")),
        }
    )
    quota = F.floor(F.lit(Decimal(ratio)) * F.col("n") + F.lit(Decimal("0.5")))
    before = F.col("upto") - F.col("count")
    boundary = (
        running.withColumn("quota", quota.cast("bigint"))
        .filter((before < F.col("quota")) & (F.col("quota") <= F.col("upto")))
        .select(
            F.col("stratum").alias("b_stratum"),
            F.col("prefix").alias("b_prefix"),
            "n",
            (F.col("quota") - before).alias("needed"),
        )
    )
    candidates = prefixed.join(
        boundary,
        F.col("stratum").eqNullSafe(F.col("b_stratum")) & (F.col("prefix") == F.col("b_prefix")),
    )
    ranked = candidates.withColumn(
        "rank", F.row_number().over(Window.partitionBy("stratum").orderBy("hash"))
    )
    return ranked.filter("rank = needed").select("stratum", "n", F.col("hash").alias("cut"))


def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str | None = None,
    ratio: str = TRAIN_RATIO,
    seed: int = SPLIT_SEED,
    out: str = "is_train",
) -> DataFrame:
    """The table with a boolean column that is true for training rows.

    Each stratum (missing is one of its own) has exactly ratio * n training
    rows, halves rounded up. A stratum column with more distinct values than
    half the rows is ignored. The key must identify a row.
    """
    value = F.lit(0) if stratum is None else F.col(stratum)
    hashed = df.select(value.alias("stratum"), split_hash(key, seed).alias("hash"))
    sizes = hashed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("strata")).first()
    rows, strata = total["rows"] or 0, total["strata"]

    if stratum is None or 2 * strata > rows:
        hashed = hashed.withColumn("stratum", F.lit(0))
        cut = _cuts(hashed, rows, ratio).first()
        in_train = F.lit(False) if cut is None else split_hash(key, seed) <= cut["cut"]
        return df.withColumn(out, in_train)

    cuts = _cuts(hashed, rows, ratio).select(
        F.col("stratum").alias("_stratum"), F.col("n").alias("_n"), F.col("cut").alias("_cut")
    )
    cuts = stage(cuts, "cuts")
    marked = F.coalesce(split_hash(key, seed) <= F.col("_cut"), F.lit(False))
    same = value.eqNullSafe(F.col("_stratum"))
    # Hot strata, fewer than HOT_SHARE, are matched without a shuffle; all others
    # are small enough to be shuffled.
    is_hot = F.col("_n") * HOT_SHARE > rows
    hot_cuts, cold_cuts = F.broadcast(cuts.filter(is_hot)), cuts.filter(~is_hot)
    if strata == cuts.filter(is_hot).count():
        labelled = df.join(hot_cuts, same, "left")
    else:
        labelled = df.join(hot_cuts, same).unionAll(
            df.join(hot_cuts, same, "left_anti").join(cold_cuts, same, "left")
        )
    return labelled.withColumn(out, marked).drop("_stratum", "_n", "_cut")

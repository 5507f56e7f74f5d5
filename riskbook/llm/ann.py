"""Nearest neighbours by shifted Hilbert orderings, with an exact pass for what they miss.

Vectors are projected to a few dimensions, shifted, and ordered along a Hilbert curve; several
projections and shifts give several orderings, each range-partitioned into blocks of equal
size. A query merges the blocks around its place in every ordering and reranks their vectors:
that gives its provisional neighbours, and with them a score that a better one must reach.

On data without low-dimensional structure no window of bounded size finds nine tenths of the
neighbours (measured in the README). So blocks of the first ordering, kept as packed matrices
with a centre and a radius, are then met by packed queries: a block whose bound (inner
product with the centre plus radius) is below the score to reach is passed over, the others are
scored by one matrix product. The result is exact. The query set is a stated part of the
rows, dealt in chunks against blocks; each task keeps the best of a chunk alone.

Equal vectors are one row with their smallest ids, as many as a query can return, so a vector
with any number of copies costs one row. For vectors of unequal length an extra coordinate
turns the largest inner product into the smallest distance.

Distinct vectors are numbered by their smallest id, so that those tied at the cut leave in the
order of the result. Where no id has two vectors, a query needs k + 1 of them: each but its own
class brings an id no larger than what comes after. Where an id has up to m different vectors, m
classes may bring the same id and score or the query's own id, so (k + 1) m are kept.

Scores are sums of products in double precision, added in the order of the coordinates.

Defined cases: ids are numbers; vectors null, zero or with null or non-finite components take no part, nor do
those whose length is not the most common one (of equally common ones the smallest); rows that
repeat both id and vector count once; vectors without an id are neither queries nor neighbours; two rows with one id and different vectors are both
candidates, but never for a query of that id, and each of them as a query has its own list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import BUCKETS, _running
from .workspace import Workspace


@dataclass(frozen=True)
class Orders:
    """``curves`` orderings of ``dims`` projected coordinates of ``bits`` bits, in blocks of ``block`` rows."""

    curves: int = 4
    dims: int = 6
    bits: int = 10
    block: int = 512
    seed: int = 17


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of grid cells (rows of unsigned coordinates) along the Hilbert curve.

    The transposed form of the place is made from the coordinates bit plane by bit plane
    (exchange and invert the lower bits, then Gray-decode), for all rows at once.
    """
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    n, one = len(x), np.uint64(1)
    plane = one << np.uint64(bits - 1)
    while plane > one:
        low = plane - one
        for i in range(n):
            high = (x[i] & plane) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        plane >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(x[0]), dtype=np.uint64)
    plane = one << np.uint64(bits - 1)
    while plane > one:
        flip = np.where((x[n - 1] & plane) != 0, flip ^ (plane - one), flip)
        plane >>= one
    key = np.zeros(len(x[0]), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | ((x[i] ^ flip) >> np.uint64(b) & one)
    return key.astype(np.int64)


def projection(dim: int, curve: int, orders: Orders) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (columns) and the shift of one ordering, from its seed."""
    rng = np.random.Generator(np.random.PCG64([orders.seed, curve]))
    basis, _ = np.linalg.qr(rng.standard_normal((dim, min(dim, orders.dims))))
    return basis, rng.uniform(0, 1, basis.shape[1])


def keys(vectors: np.ndarray, longest: float, curve: int, orders: Orders) -> np.ndarray:
    """Place of each vector in an ordering; coordinates span twice the longest vector."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    wide = np.column_stack([vectors, rest]) / longest
    basis, shift = projection(wide.shape[1], curve, orders)
    cells = 1 << orders.bits
    grid = ((wide @ basis + 1) / 2 + shift) / 2 * cells
    return hilbert_key(np.clip(grid, 0, cells - 1).astype(np.int64), orders.bits)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in the order of the coordinates."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the vectors that take part, without repeated rows."""
    v = F.col(vector)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(fine).select(F.col(vec_id).alias("vec_id"), v.cast("array<double>").alias("vector")).distinct()
    sizes = good.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    return good.where(F.size("vector") == (top[0]["dim"] if top else -1))


def classes(good: DataFrame, k: int) -> DataFrame:
    """(node, vector, ids): distinct vectors, with their ``k + 1`` smallest ids, ascending.

    Ids beyond those can't be among the k nearest of any query. The ranks are cut down before
    the shuffle, so a vector with many copies doesn't gather them anywhere.
    """
    a, b = F.xxhash64("vector", F.lit(1)), F.xxhash64("vector", F.lit(2))
    few = good.withColumn("node", F.struct(a.alias("a"), b.alias("b"))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys_ in (["node", "salt"], ["node"]):
        place = F.row_number().over(Window.partitionBy(*keys_).orderBy("vec_id"))
        few = few.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("node").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of doubles with equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def placed(nodes: DataFrame, longest: float, orders: Orders) -> DataFrame:
    """(curve, position, number, vector): every vector's position in every ordering."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1))
            for curve in range(orders.curves):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(vectors), curve, dtype=np.int32)),
                        pa.array(keys(vectors, longest, curve, orders)),
                        batch.column(0),
                    ],
                    names=["curve", "key", "number"],
                )

    ordered = nodes.select("number", "vector").mapInArrow(batches, "curve int, key long, number long").withColumn("one", F.lit(1))
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = ordered.groupBy("curve").agg(F.percentile_approx("key", steps, 10_000).alias("bounds"))
    ranged = ordered.join(F.broadcast(bounds), "curve").withColumn(
        "range", F.size(F.filter(F.array_distinct("bounds"), lambda b: b < F.col("key")))
    )
    running = _running(ranged.drop("bounds"), ["curve"], "range", [F.col("key"), F.col("number")], "one")
    return running.select("curve", (F.col("running") - 1).alias("position"), "number")


def _pack(rows: DataFrame, group: list[str], prefix: str, extra: str | None = None) -> DataFrame:
    """One row for each block of (number, vector): their numbers and one flat list of coordinates."""
    fields = ["number", "vector", *([extra] if extra else [])]
    packed = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    out = [F.col("rows.number").alias(f"{prefix}_number"), F.flatten("rows.vector").alias(f"{prefix}_flat")]
    if extra:
        out.append(F.col(f"rows.{extra}").alias(f"{prefix}_{extra}"))
    return packed.select(*group, *out)


class _Best:
    """The best ``k`` scores of each query of a chunk, as far as blocks have been seen."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, reach: np.ndarray, k: int):
        self.queries, self.vectors, self.k = queries, vectors, k
        self.reach = reach - 1e-9 * np.abs(reach)
        self.scores = np.full((len(queries), k), -np.inf)
        self.numbers = np.full((len(queries), k), -1, dtype=np.int64)
        self.lengths = np.sqrt((vectors**2).sum(axis=1))

    def see(self, numbers: np.ndarray, block: np.ndarray) -> None:
        centre = block.mean(axis=0)
        radius = np.sqrt(((block - centre) ** 2).sum(axis=1).max())
        # the slack is far above what rounding can take from a sum, so that no tie is lost to it
        slack = 1e-9 * self.lengths * np.sqrt((block**2).sum(axis=1).max())
        need = np.maximum(self.reach, self.scores[:, -1]) - slack
        may = np.flatnonzero(self.vectors @ centre + self.lengths * radius >= need)
        if not len(may):
            return
        near = self.vectors[may] @ block.T
        row, column = np.nonzero(near >= need[may, None])
        if not len(row):
            return
        exact = products(self.vectors[may[row]], block[column])
        for i in np.unique(row).tolist():
            own = row == i
            q = may[i]
            scores = np.append(self.scores[q], exact[own])
            found = np.append(self.numbers[q], numbers[column[own]])
            order = np.lexsort((found, -scores))[: self.k]
            self.scores[q], self.numbers[q] = scores[order], found[order]

    def rows(self) -> pa.RecordBatch:
        kept = (self.numbers >= 0) & (self.scores >= self.reach[:, None])
        q, place = np.nonzero(kept)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries[q]), pa.array(self.numbers[q, place]), pa.array(self.scores[q, place])],
            names=["query", "number", "score"],
        )


def meet(pairs: DataFrame, keep: int) -> DataFrame:
    """(query, number, score): the best ``keep`` of each chunk's queries in the blocks a task sees.

    ``pairs``: (chunk, q_number, q_flat, q_reach, b_number, b_flat), sorted by chunk in every partition.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, best = None, None
        for batch in source:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if best is None or name != chunk:
                    if best is not None:
                        yield best.rows()
                    queries = np.asarray(batch.column(1)[i].values)
                    vectors = np.asarray(batch.column(2)[i].values).reshape(len(queries), -1)
                    chunk, best = name, _Best(queries, vectors, np.asarray(batch.column(3)[i].values), keep)
                numbers = np.asarray(batch.column(4)[i].values)
                best.see(numbers, np.asarray(batch.column(5)[i].values).reshape(len(numbers), -1))
        if best is not None:
            yield best.rows()

    columns = ["chunk", "q_number", "q_flat", "q_reach", "b_number", "b_flat"]
    return pairs.select(*columns).mapInArrow(batches, "query long, number long, score double")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    orders: Orders = Orders(), exact: bool = True,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. With ``exact=False`` the windows alone answer.
    """
    work = Workspace(vectors.sparkSession, "ann")
    good = work.save(usable(vectors, vec_id, vector), "good")
    good = good.where("vec_id is not null")
    found = work.save(classes(good, k), "classes").withColumn("least", F.col("ids")[0]).withColumn("one", F.lit(1))
    # distinct vectors get numbers from 0 in the order of their smallest ids, by counts of ranges
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = found.agg(F.percentile_approx("least", steps, 10_000).alias("bounds"))
    ranged = found.crossJoin(F.broadcast(bounds)).withColumn(
        "range", F.size(F.filter(F.array_distinct("bounds"), lambda b: b < F.col("least")))
    )
    numbered = _running(ranged.drop("bounds"), [], "range", [F.col("least"), F.col("node")], "one")
    nodes = work.save(numbered.select((F.col("running") - 1).alias("number"), "node", "vector", "ids"), "nodes")
    asked = good.where(is_query).select(F.col("vec_id").alias("query_id"), F.struct(
        F.xxhash64("vector", F.lit(1)).alias("a"), F.xxhash64("vector", F.lit(2)).alias("b")).alias("node"))
    asked = work.save(asked.join(nodes.select("node", "number"), "node").select("query_id", "number"), "asked")
    longest = nodes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"]
    queries = asked.select("number").distinct()
    # an id counts once for each of its vectors, and a query's own classes may hold nothing but itself
    most = good.groupBy("vec_id").count().agg(F.max("count").alias("m")).first()["m"]
    keep = (k + 1) * (most or 1)

    position = work.save(placed(nodes.select("number", "vector"), float(longest or 1.0) ** 0.5, orders), "placed")
    half = orders.block // 2
    full = nodes.select("number", "vector")
    block = F.floor(F.col("position") / orders.block).cast("long")
    blocks = work.save(
        _pack(position.withColumn("block", block).join(full, "number"), ["curve", "block"], "b"), "blocks"
    )

    # windows: the blocks that hold the half block before and behind a query's place
    at = position.join(queries, "number")
    around = F.array_distinct(
        F.array(*[F.floor(F.greatest(F.col("position") + d, F.lit(0)) / orders.block).cast("long") for d in (-half, half)])
    )
    nothing = F.lit(float("-inf"))
    windows = at.withColumn("block", F.explode(around)).join(full, "number").withColumn("reach", nothing)
    windows = _pack(windows, ["curve", "block"], "q", "reach").join(blocks, ["curve", "block"])
    chunked = windows.withColumn("chunk", F.xxhash64("curve", "block")).repartition("chunk").sortWithinPartitions("chunk")
    first = meet(chunked, keep).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "number")
    first = work.save(first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).drop("place"), "windows")
    result = first
    if exact:
        reach = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        reach = reach.select(F.col("query").alias("number"), F.when(F.col("n") >= keep, F.col("least")).otherwise(nothing).alias("reach"))
        chunk = F.floor(F.col("position") / (orders.block * 16)).cast("long")
        chunks = at.where("curve = 0").withColumn("chunk", chunk).join(reach, "number").join(full, "number")
        chunks = _pack(chunks, ["chunk"], "q", "reach")
        own = blocks.where("curve = 0").drop("curve")
        # a grid: groups of about 32 blocks by groups of about 8 chunks, each pair a key of its own
        last_block, last_chunk = own.agg(F.max("block")).first()[0] or 0, chunks.agg(F.max("chunk")).first()[0] or 0
        down, across = last_block // 32 + 1, last_chunk // 8 + 1
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        dealt = own.withColumn("row", F.pmod("block", F.lit(down))).withColumn("column", upto(across))
        sent = chunks.withColumn("column", F.pmod("chunk", F.lit(across))).withColumn("row", upto(down))
        pairs = sent.join(dealt.hint("shuffle_hash"), ["row", "column"]).sortWithinPartitions("row", "chunk")
        result = meet(pairs, keep)

    rows = (
        result.join(asked.withColumnRenamed("number", "query"), "query")
        .join(nodes.select("number", "ids"), "number")
        .select("query_id", "query", F.explode("ids").alias("vec_id"), "score")
        .where(F.col("vec_id") != F.col("query_id"))
        .distinct()
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    out = work.save(
        rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "result"
    )
    work.keep_only("result")
    return out


#: The search over ``embeddings`` for DuckDB, for rows whose id is divisible by 20.
SQL = """
with good as (
  select distinct vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

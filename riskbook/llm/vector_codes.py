"""Compress vectors to codes by product quantisation in integers, with active-entry Lloyd rounds.

Vectors are cut into equal parts, and every part position has a codebook. A round assigns each
part to its nearest entry (squared distance, ties to the lower index) and moves each entry to
the floor of its parts' mean. Everything is integer arithmetic, so results hang on no order.

A row carries the index and the exact distance of each part's entry from round to round. An
entry is active in a round if the last one moved it. Where a part's own entry stayed, all
distances to entries that stayed are as they were and none of them beats it, so the part is
compared with the active ones only; where it moved, the part is compared with all.

Rows never shuffle: each round reads the table the last one wrote and writes rows with their new
state, and beside them, per task, the sums and counts of its entries, which Spark adds up. The
driver holds the codebooks: entries x entries a vector, never more.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped,
as are rows of another length than most have; with fewer rows than entries the codebooks are as
many as the rows; rows that share an id are ordered by their vectors, a null id comes last;
equal labels are summed together, null ones too; other columns are not read; an empty table
has no rows. Integers beyond ``LARGEST`` (where a distance would leave a long) and lengths
that the parts don't divide are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vectors
from .workspace import Workspace

PARTS, ENTRIES, ROUNDS = 4, 256, 4
LARGEST = 2**27
#: Below that, distances are exact in doubles, whose matrix products are fast.
SMALL = 2**22
#: Rows compared with a codebook at once.
BLOCK = 4096
#: Parts that the rows of a label are dealt in, when its sum is joined back.
SALTS = 32


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of book, exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < SMALL:
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    found = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        found += (x[:, i, None] - book[:, i]) ** 2
    return found


def assign(x: np.ndarray, book: np.ndarray, active: np.ndarray, code: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New (code, distance) of one part of some rows; ``code`` is -1 before the first round."""
    code, far = code.copy(), far.copy()
    stale = (code < 0) | active[code]
    for rows in np.array_split(np.flatnonzero(stale), max(1, -(-int(stale.sum()) // BLOCK))):
        found = distances(x[rows], book)
        code[rows] = found.argmin(1)
        far[rows] = found[np.arange(len(rows)), code[rows]]
    moved = np.flatnonzero(active)
    if len(moved):
        fixed = np.flatnonzero(~stale)
        for rows in np.array_split(fixed, max(1, -(-len(fixed) // BLOCK))):
            found = distances(x[rows], book[moved])
            best = found.argmin(1)
            near = found[np.arange(len(rows)), best]
            better = (near < far[rows]) | ((near == far[rows]) & (moved[best] < code[rows]))
            code[rows[better]] = moved[best[better]]
            far[rows[better]] = near[better]
    return code, far


class Books:
    """Codebooks, and which entries the last round moved."""

    def __init__(self, entries: np.ndarray, active: np.ndarray | None = None):
        self.entries = entries  # part, entry, place
        self.active = np.ones(entries.shape[:2], bool) if active is None else active

    def moved_to(self, totals: list) -> Books:
        """After a round, from rows (part, entry, n, sums)."""
        new = self.entries.copy()
        for r in totals:
            new[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
        return Books(new, (new != self.entries).any(2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


_STATE = "code array<int>, far array<long>"
_SUMS = "part int, entry int, n long, sums array<long>"


def _round(books: Books, dim: int, id_type: pa.DataType, label_type: pa.DataType):
    """One pass: rows with their new state, then the task's sums of entries."""
    parts, entries, width = books.entries.shape
    schema = pa.schema([
        ("vec_id", id_type), ("label", label_type), ("x", pa.list_(pa.int64())), ("code", pa.list_(pa.int32())),
        ("far", pa.list_(pa.int64())), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = batch.num_rows
            x = vectors.matrix(batch.column("x"), dim).astype(np.int64).reshape(rows, parts, width)
            code = vectors.matrix(batch.column("code"), parts).astype(np.int32)
            far = vectors.matrix(batch.column("far"), parts).astype(np.int64)
            for p in range(parts):
                c, f = assign(x[:, p], books.entries[p], books.active[p], code[:, p], far[:, p])
                code[:, p], far[:, p] = c, f
                counts[p] += np.bincount(c, minlength=entries)
                order = np.argsort(c, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0]) if rows else []
                if len(starts):
                    sums[p, c[order[starts]]] += np.add.reduceat(x[order, p], starts, axis=0)
            state = [batch.column("vec_id"), batch.column("label"), batch.column("x"), vectors.lists(code), vectors.lists(far)]
            nothing = [pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(a.cast(f.type) for a, f in zip(state, schema)), *nothing], schema=schema)
        p, e = np.nonzero(counts)
        blank = [pa.nulls(len(p), f.type) for f in list(schema)[:5]]
        found = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), vectors.lists(sums[p, e])]
        yield pa.RecordBatch.from_arrays([*blank, *found], schema=schema)

    return run


def first_books(x: DataFrame, parts: int, entries: int, dim: int) -> Books:
    """The vectors of the smallest ids."""
    rows = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return Books(np.array([r["x"] for r in rows], np.int64).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2))


def compress(
    table: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = 1024,
) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, far) of every usable row after the rounds, and the codebooks.

    ``code`` has the index of each part's entry, ``far`` the squared distances to them.
    """
    if entries > 256:
        raise ValueError("an index takes one byte")
    spark = table.sparkSession
    work = Workspace(spark, "codes")
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)))
    x = table.where(vectors.usable(F.col(vector))).select(
        F.col(id_column).alias("vec_id"), F.col(label).alias("label"), whole.alias("x")
    )
    x = work.save(x, "x")
    dim = vectors.common_length(x, "x")
    if dim % parts:
        raise ValueError(f"{dim} entries can't be cut into {parts} equal parts")
    x = x.where(F.size("x") == dim)
    most = x.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m")).first()["m"]
    if most is not None and most >= LARGEST:
        raise ValueError(f"entries beyond {LARGEST} after scaling: distances would leave a long")
    books = first_books(x, parts, entries, dim)
    names = {c: x.schema[c].dataType for c in ("vec_id", "label")}
    kept = ", ".join(f"{c} {t.simpleString()}" for c, t in names.items())
    if not books.entries.shape[1]:
        return spark.createDataFrame([], f"{kept}, {_STATE}"), books
    arrow = [to_arrow_type(t) for t in names.values()]
    state = x.select("*", F.array_repeat(F.lit(-1), parts).alias("code"), F.array_repeat(F.lit(0).cast("long"), parts).alias("far"))
    for k in range(rounds + 1):
        passed = state.mapInArrow(_round(books, dim, *arrow), f"{kept}, x array<long>, {_STATE}, {_SUMS}")
        done = work.save(passed, f"round-{k}")
        work.drop(f"round-{k - 1}" if k else "x")
        state = done.where(F.col("x").isNotNull()).select(*names, "x", "code", "far")
        if k < rounds:
            width = dim // parts
            sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])
            totals = done.where(F.col("part").isNotNull()).groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums"))
            books = books.moved_to(totals.collect())
    return state.drop("x"), books


def code_text(code: str = "code") -> Column:
    """Two hex digits for each index."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, error, ...) and the error summed over rows of equal label.

    A label's sum is repeated for each salt, so its rows are dealt over ``SALTS`` tasks.
    """
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    totals = totals.select(F.col("label").alias("sum_label"), "label_error", salts.alias("sum_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = salted["label"].eqNullSafe(totals["sum_label"]) & (salted["salt"] == totals["sum_salt"])
    return salted.join(totals, same).drop("salt", "sum_salt", "sum_label")


def codes(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    rows, books = compress(table)
    error = F.aggregate("far", F.lit(0).cast("long"), lambda a, f: a + f)
    found = rows.select("vec_id", "label", code_text().alias("code"), error.alias("error"))
    return with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The codes of ``embeddings`` for DuckDB: the rounds written out, every part compared with every entry."""
    book = """book0 as materialized (
  select part, e, list(x order by i) as c from cells join (
    select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < 256
  ) using (vec_id) group by part, e
)"""
    steps = [book]
    squares = "list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} as materialized (
  select vec_id, part, arg_min(e, d * 256 + e) as e, min(d) as d from (
    select vec_id, part, e, cast(list_sum({squares}) as bigint) as d from pieces join book{k} using (part)
  ) group by vec_id, part
)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} as materialized (
  select b.part, b.e, coalesce(m.c, b.c) as c from book{k} b left join (
    select part, e, list(c order by i) as c from (
      select part, e, i, cast(floor(sum(x) / count(*)) as bigint) as c
      from cells join near{k} using (vec_id, part) group by part, e, i
    ) group by part, e
  ) m on b.part = m.part and b.e = m.e
)""")
    return f"""
with kept as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)
), cells as materialized (
  select vec_id, (i - 1) // (len(embedding) // 4) as part, i,
         cast(floor(cast(embedding[i] as double) * 1024) as bigint) as x
  from (select *, unnest(range(1, len(embedding) + 1)) as i from kept)
), pieces as materialized (
  select vec_id, part, list(x order by i) as v from cells group by vec_id, part
), {", ".join(steps)}, found as (
  select vec_id, string_agg(printf('%02x', e), '' order by part) as code, cast(sum(d) as bigint) as error
  from near{ROUNDS} group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) from book{ROUNDS}) as codebooks_sha256
from found join kept using (vec_id)
"""


SQL = _sql()

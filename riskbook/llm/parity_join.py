"""Similarity join of documents by parity sketches: components of n-gram Jaccard links.

A document's set holds its distinct word n-grams. Two documents link when their sets' Jaccard
similarity reaches a threshold; the components of all links are found exactly.

* A *parity sketch* XORs every n-gram's hash into a row of cells. An n-gram in only one of two
  sets changes one cell at most, so the number of cells that differ never exceeds the
  symmetric difference, and linked sets differ in few cells.
* *Pigeonhole*: in a size band all sketches have the same number of cells, more than linked
  sets may differ in, so linked sets agree in some cell. Cells are ranked by rarity (cells
  made of common n-grams or empty ones last, then by hash), and a document publishes just as
  many of the first ones as its largest possible difference demands: if sketches agree
  in all but d cells, their first d + 1 cells in any common order share one.
* Documents that publish the same cell form a group. Each is compared with the group's hub
  (the member that shares most cells), so a group costs its size and not its square. The
  comparison is the sketches' bit form: more differing bits than the possible symmetric
  difference rule a link out.
* Groups that this leaves in several pieces have the pieces' members compared in blocks,
  inside a task; a block reports a spanning forest of the pairs that may link, never all pairs.
* The reported pairs are verified on the n-grams themselves. Groups whose sketches still leave a
  link possible across the components found have the members of those components compared
  once more, now with their sets beside them: wider sketches rule out nearly all pairs, the sets
  decide the others inside the task, and again only a forest of true links is reported. Every
  other pair is ruled out by the bound or lies in one component already, so no link is lost.

Equal sets are one node from the start, so a large group of copies is one row. Common n-grams
only rank last; that choice affects the work, never the result.

Sets are compared by 54-bit n-gram hashes, and nodes are named by 64-bit hashes of the set.

Defined cases: a null or blank text has no n-grams and is linked with nothing; a text with fewer
words than n has its whole word sequence as its one n-gram; rows that share an id count as
one document, whose sets are all linked with each other; rows without an id take part like
others, and a component made of only such rows has no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import ranges
from .components import connected_components
from .textbuf import LOWER, Slice, _random, mix, text_slices, windows
from .workspace import Workspace, free_name

_U = np.uint64
HASH_BITS = 54
_CELL, _BAND, _NODE = (_random(3, 23) | _U(1)).tolist()
_LENGTHS = _random(64, 29)


@dataclass(frozen=True)
class Link:
    """Link condition: n-grams of ``words`` words, similarity of at least ``percent`` hundredths.

    ``common`` is the share of documents from which on an n-gram ranks last, and
    ``most_common`` bounds how many of those are kept (the most frequent).
    """

    words: int = 5
    percent: int = 75
    common: float = 1e-4
    most_common: int = 500_000
    block: int = 1024

    def most_difference(self, a, b):
        """Largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, n):
        return n * 100 // self.percent

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)


#: Size bands: band j holds sizes below 16 ** j and at or above 16 ** (j - 1).
BAND_RATIO_LOG2 = 4


def band_of(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(n + 1) / BAND_RATIO_LOG2 - 1e-12).astype(np.int64)


def band_top(band: np.ndarray) -> np.ndarray:
    """Sizes in a band are below this."""
    return np.int64(1) << (BAND_RATIO_LOG2 * band)


def cells_of(band: np.ndarray, link: Link) -> np.ndarray:
    """Cells of the band's sketches: a quarter more than linked sets can differ in, at least two more."""
    most = link.most_difference(band_top(band), band_top(band))
    return most + most // 4 + 2


class Grams:
    """Distinct n-grams of a slice's rows as hashes, ascending within a row.

    Row i owns ``hashes[bounds[i]:bounds[i + 1]]``.
    """

    def __init__(self, part: Slice, link: Link):
        data = LOWER[part.data]
        words = part.words(data)
        hashes, rows, n = words.hashes(data), words.rows(), link.words
        wide = windows(hashes, n)
        inside = np.flatnonzero(np.arange(len(wide)) + n <= words.bounds[1:][rows[: len(wide)]])
        gram, owner = wide[inside], rows[inside]
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        extra = np.array([self._whole(hashes[words.bounds[i] : words.bounds[i + 1]]) for i in short.tolist()], dtype=np.uint64)
        gram, owner = np.concatenate([gram, extra]), np.concatenate([owner, short])
        # rows fit above the hash because a slice has at most 1024 of them
        key = np.sort(owner.astype(np.uint64) << _U(HASH_BITS) | gram >> _U(64 - HASH_BITS))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        self.owner = (key >> _U(HASH_BITS)).astype(np.int64)
        self.hashes = key & _U((1 << HASH_BITS) - 1)
        self.bounds = np.searchsorted(self.owner, np.arange(part.n + 1))
        self.sizes = np.diff(self.bounds)

    @staticmethod
    def _whole(hashes: np.ndarray) -> np.uint64:
        total = np.zeros(1, dtype=np.uint64)
        for i in range(len(hashes)):
            total = mix(total + hashes[i : i + 1] * _LENGTHS[i % 64])
        return mix(total ^ _LENGTHS[len(hashes) % 64])[0]

    def nodes(self) -> np.ndarray:
        """A 64-bit name of each row's set; 0 for an empty one."""
        mixed = mix(self.hashes * _U(_NODE))
        total = np.zeros(len(mixed) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=total[1:])
        out = mix((total[self.bounds[1:]] - total[self.bounds[:-1]]) ^ (self.sizes.astype(np.uint64) * _U(_BAND)))
        return np.where(self.sizes > 0, out, _U(0)).astype(np.int64)

    def bits(self) -> list[bytes]:
        """Parity sketches of single bits, at least twice as many as the set has members."""
        sizes = np.int64(1) << np.ceil(np.log2(np.maximum(2 * self.sizes, 64))).astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        place = offsets[self.owner] + (self.hashes & (sizes[self.owner] - 1).astype(np.uint64)).astype(np.int64)
        flat = np.packbits((np.bincount(place, minlength=offsets[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [flat[a // 8 : b // 8] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def cells(self, rows: np.ndarray, bands: np.ndarray, common: np.ndarray, link: Link) -> tuple[np.ndarray, np.ndarray]:
        """(row, published cell) of the given rows in the given bands."""
        sizes = self.sizes[rows]
        at = ranges(self.bounds[rows], sizes)
        owner = np.repeat(np.arange(len(rows)), sizes)
        cells = cells_of(bands, link)
        gram = self.hashes[at]
        # cells are ranges of the hash, so ascending hashes come cell by cell
        cell = ((gram >> _U(HASH_BITS - 32)) * cells[owner].astype(np.uint64)) >> _U(32)
        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1]))) if len(at) else np.zeros(0, np.int64)
        if len(common):
            place = np.minimum(np.searchsorted(common, gram), len(common) - 1)
            rare = common[place] != gram
        else:
            rare = np.ones(len(gram), dtype=bool)
        parity = np.bitwise_xor.reduceat(mix(gram + _U(1)), start) if len(start) else gram
        weak = ~np.logical_or.reduceat(rare, start) if len(start) else rare
        owner, cell = owner[start], cell[start]
        name = lambda value, cell, band: mix(value ^ (cell * _U(_CELL)) ^ (band.astype(np.uint64) * _U(_BAND)))
        token = name(parity, cell, bands[owner])
        largest = np.minimum(link.largest_partner(sizes), band_top(bands) - 1)
        need = link.most_difference(sizes, np.maximum(largest, sizes)) + 1
        order = np.lexsort((token, weak, owner))
        first = np.searchsorted(owner, np.arange(len(rows) + 1))
        rank = np.arange(len(order)) - first[owner[order]]
        chosen = order[rank < need[owner[order]]]
        out_row, out_token = [rows[owner[chosen]]], [token[chosen]]
        # a small set may not fill enough cells; then empty cells are published, in their order
        lacking = need - np.diff(first)
        for i in np.flatnonzero(lacking > 0).tolist():
            used = np.zeros(int(cells[i]), dtype=bool)
            used[cell[first[i] : first[i + 1]].astype(np.int64)] = True
            empty = np.flatnonzero(~used).astype(np.uint64)
            names = np.sort(name(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), bands[i])))
            out_token.append(names[: lacking[i]])
            out_row.append(np.full(min(len(names), int(lacking[i])), rows[i]))
        return np.concatenate(out_row), np.concatenate(out_token)


CHUNK = 1 << 20  # n-grams that are counted together


def describe(docs: DataFrame, link: Link) -> DataFrame:
    """One pass over all texts: each row's node, set size and bit sketch, and n-grams seen often.

    Rows with ``gram`` set are counts of n-grams that occur in three or more sets of a chunk
    of about a million n-grams.
    """

    def often(chunk: list[np.ndarray]) -> pa.RecordBatch | None:
        gram, times = np.unique(np.concatenate(chunk), return_counts=True)
        keep = times >= 3
        return batch(gram=gram[keep].astype(np.int64), times=times[keep]) if keep.any() else None

    def batch(rows: pa.Array | None = None, node=None, n=None, bits=None, gram=None, times=None) -> pa.RecordBatch:
        size = len(rows) if rows is not None else len(gram)
        fill = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(size, id_kind) if rows is None else rows,
                fill(node, pa.int64()), fill(n, pa.int64()), fill(bits, pa.binary()),
                fill(gram, pa.int64()), fill(times, pa.int64()),
            ],
            names=["doc_id", "node", "n", "bits", "gram", "times"],
        )

    id_kind = pa.int64()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, seen = [], 0, set()
        for got in source:
            for part in text_slices(got.column(1), max_rows=1024):
                grams = Grams(part, link)
                nodes = grams.nodes()
                yield batch(got.column(0)[part.rows], nodes, grams.sizes, grams.bits())
                new = [i for i, v in enumerate(nodes.tolist()) if v not in seen and not seen.add(v)]
                at = ranges(grams.bounds[new], grams.sizes[new])
                chunk.append(grams.hashes[at])
                held += len(at)
                if held >= CHUNK:
                    if (out := often(chunk)) is not None:
                        yield out
                    chunk, held, seen = [], 0, set()
        if chunk and (out := often(chunk)) is not None:
            yield out

    schema = "doc_id long, node long, n long, bits binary, gram long, times long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, schema)


def common_grams(described: DataFrame, link: Link) -> np.ndarray:
    """Hashes of n-grams in at least the share ``common`` of documents, ascending.

    At most (mean set size / share) n-grams can be that common, and of those ``most_common``
    are kept: the list that every task gets is bounded whatever the input.
    """
    documents = described.where("gram is null").count()
    counted = described.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    counted = counted.where(F.col("times") >= max(20, link.common * documents))
    rows = counted.orderBy(F.desc("times"), "gram").limit(link.most_common).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(dtype=np.int64).astype(np.uint64))


def published_cells(docs: DataFrame, common: np.ndarray, link: Link) -> DataFrame:
    """(token, node, n): the cells that every set publishes in its size bands."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            done: set[int] = set()  # copies within a batch publish once
            for part in text_slices(got.column(0), max_rows=1024):
                grams = Grams(part, link)
                nodes = grams.nodes()
                new = [i for i, v in enumerate(nodes.tolist()) if v and v not in done and not done.add(v)]
                rows = np.array(new, dtype=np.int64)
                bands = band_of(grams.sizes[rows])
                up = link.largest_partner(grams.sizes[rows]) >= band_top(bands)
                rows, bands = np.append(rows, rows[up]), np.append(bands, bands[up] + 1)
                if len(rows):
                    row, token = grams.cells(rows, bands, shared.value, link)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token.astype(np.int64)), pa.array(nodes[row]), pa.array(grams.sizes[row])],
                        names=["token", "node", "n"],
                    )

    return docs.select("text").mapInArrow(batches, "token long, node long, n long")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bit sketch (last axis: 64-bit words) at a smaller power of two, by XOR of its pieces."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, link: Link) -> bool:
    """Whether sizes and bit sketches leave a link of two sets possible."""
    if max(na, nb) > link.largest_partner(min(na, nb)):
        return False
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum()) <= link.most_difference(na, nb)


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]


def plausible(pairs: DataFrame, nodes: DataFrame, link: Link) -> DataFrame:
    """The pairs (a, n_a, b, n_b) that sizes and bit sketches don't rule out, as (a, b)."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"))
    near = pairs.where(100 * F.least("n_a", "n_b") >= link.percent * F.greatest("n_a", "n_b"))
    both = near.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            na, nb = got.column(2).to_pylist(), got.column(3).to_pylist()
            a, b = _words(got.column(4)), _words(got.column(5))
            keep = [may_link(a[i], na[i], b[i], nb[i], link) for i in range(len(na))]
            yield got.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(batches, "a long, b long")


def block_pairs(members: DataFrame, content: DataFrame, link: Link, exact: bool = False) -> DataFrame:
    """A spanning forest (group, a, b) over the pieces of each group, of pairs that may link.

    ``members``: (group, node, n, piece); ``content``: (node, bits) with their bit sketches, or if
    ``exact`` (node, grams) with their sets, which leaves pairs that do link. Groups above
    ``link.block`` members or ``BLOCK_GRAMS`` n-grams are cut into blocks by a hash of the node, and
    every pair of blocks is compared by itself. A task streams over its blocks in order, as
    many at a time as fit ``CHUNK_ROWS`` and ``CHUNK_BYTES``. The content joins last, so it is
    shuffled once.
    """
    of_group = Window.partitionBy("group")
    sized = members.withColumn("size", F.count(F.lit(1)).over(of_group)).withColumn("total", F.sum("n").over(of_group))
    parts = F.ceil(F.greatest(F.col("size") / link.block, F.col("total") / BLOCK_GRAMS)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    keys = ["group", "low", "high"]
    spread = (
        sized.withColumn("parts", parts).withColumn("own", own).withColumn("other", other)
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .select(*keys, "own", "node", "piece", "n")
        .join(content.select("node", F.col("grams" if exact else "bits").alias("content")), "node")
        .select(*keys, "own", "node", "piece", "n", "content")
        .repartition(*keys).sortWithinPartitions(*keys, "n", "node")
    )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for got in source:
            held.append(got)
            rows += got.num_rows
            size += got.nbytes
            if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = _last_start(table, keys)
                if whole:
                    yield _as_pairs(compare_blocks(table.slice(0, whole), link, exact))
                held = table.slice(whole).combine_chunks().to_batches()
                rows, size = table.num_rows - whole, sum(b.nbytes for b in held)
        if rows:
            yield _as_pairs(compare_blocks(pa.Table.from_batches(held).combine_chunks(), link, exact))

    return spread.mapInArrow(batches, "group long, a long, b long")


#: Rows and bytes of blocks that are read together, and n-grams of a block.
CHUNK_ROWS, CHUNK_BYTES = 8_192, 1 << 25
BLOCK_GRAMS = 1 << 20
#: Pairs that are compared at once.
CHUNK_PAIRS = 1 << 16


def _as_pairs(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], names=["group", "a", "b"])


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new block starts."""
    new = np.ones(table.num_rows, dtype=bool)
    columns = [table[k].to_numpy() for k in keys]
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _last_start(table: pa.Table, keys: list[str]) -> int:
    return int(_changes(table, keys)[-1])


def wide_bits(grams: np.ndarray) -> np.ndarray:
    """The bit sketch of one set at sixteen times its size or more; folds to its narrow one."""
    size = 1 << int(np.ceil(np.log2(max(16 * len(grams), 64))))
    odd = np.bincount((grams & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def compare_blocks(table: pa.Table, link: Link, exact: bool) -> list[tuple[int, int, int]]:
    """(group, node, node) of whole blocks (see ``block_pairs``), sorted by block, size and node."""
    starts = _changes(table, ["group", "low", "high"])
    count = table.num_rows
    block = np.zeros(count, dtype=np.int64)
    block[starts[1:]] = 1
    block = np.cumsum(block)
    two_sided = (table["low"].to_numpy() != table["high"].to_numpy())
    own, node, n = (table[c].to_numpy().astype(np.int64) for c in ("own", "node", "n"))
    # pieces are numbered by block, so that unions of one block stay in it
    piece = pd.factorize(pd.MultiIndex.from_arrays([block, table["piece"].to_numpy()]))[0]
    root = np.arange(piece.max() + 1)
    # partners have a size up to the largest partner's; rows of a block ascend in size
    wide = np.int64(1) << 40
    until = np.searchsorted(block * wide + n, block * wide + np.minimum(link.largest_partner(n), wide - 1), side="right")
    many = np.maximum(until - np.arange(count) - 1, 0)
    raw = _words(table["content"].combine_chunks())
    sets, raw = (raw, [wide_bits(x) for x in raw]) if exact else (None, raw)
    widths = np.array([len(b) for b in raw])
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_width(width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in folded:
            rows = np.flatnonzero(widths >= width)
            place = np.full(count, -1, dtype=np.int64)
            place[rows] = np.arange(len(rows))
            folded[width] = place, np.stack([fold(raw[i], width) for i in rows.tolist()])
        return folded[width]

    group = table["group"].to_numpy()
    found: list[tuple[int, int, int]] = []
    ends = np.cumsum(many)
    low = 0
    while low < count:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_PAIRS, side="right")))
        i = np.repeat(np.arange(low, high), many[low:high])
        j = ranges(np.arange(low, high) + 1, many[low:high])
        differ = (root[piece[i]] != root[piece[j]]) & (~two_sided[i] | (own[i] != own[j]))
        i, j = i[differ], j[differ]
        may = np.zeros(len(i), dtype=bool)
        narrow = np.minimum(widths[i], widths[j])
        for width in np.unique(narrow).tolist():
            at = np.flatnonzero(narrow == width)
            place, sketches = at_width(width)
            for part in np.array_split(at, max(1, len(at) * width // (1 << 20))):
                bits = np.bitwise_count(sketches[place[i[part]]] ^ sketches[place[j[part]]]).sum(axis=1)
                may[part] = bits <= link.most_difference(n[i[part]], n[j[part]])
        for x, y in zip(i[may].tolist(), j[may].tolist()):
            if root[piece[x]] == root[piece[y]]:
                continue
            if exact and not link.linked(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y])):
                continue
            found.append((int(group[x]), int(node[x]), int(node[y])))
            root[root == root[piece[y]]] = root[piece[x]]
        low = high
    return found


def sets_of(docs: DataFrame, wanted: DataFrame, link: Link) -> DataFrame:
    """(node, grams) of the wanted (doc_id, node): their n-gram hashes, from the texts again."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            for part in text_slices(got.column(0), max_rows=1024):
                grams = Grams(part, link)
                packed = [grams.hashes[a:b].tobytes() for a, b in zip(grams.bounds[:-1], grams.bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(grams.nodes()), pa.array(packed, pa.binary())], names=["node", "grams"])

    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    # an id that is not unique brings other sets along, which meet no pair
    named = texts.select("text").mapInArrow(batches, "node long, grams binary")
    # sets that only rows without an id hold are found among those rows by node
    nameless = docs.where("doc_id is null").select("text").mapInArrow(batches, "node long, grams binary")
    nameless = nameless.join(wanted.where("doc_id is null").select("node").distinct(), "node", "left_semi")
    return named.unionByName(nameless).dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, link: Link) -> DataFrame:
    """(a, b, linked) for each pair, by the sets themselves."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "grams_a", "grams_b")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            linked = [
                link.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))
                for a, b in zip(_words(got.column(2)), _words(got.column(3)))
            ]
            yield pa.RecordBatch.from_arrays(
                [got.column(0), got.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    return both.mapInArrow(batches, "a long, b long, linked boolean")


def in_pieces(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the piece of their node by ``labels`` (node, piece); else the node itself."""
    return members.join(labels, "node", "left").withColumn("piece", F.coalesce("piece", "node"))


def open_groups(placed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The members of groups of three or more in several pieces; of groups with the same members, one.

    A group of two is settled by its only pair: it is left out, or with ``known`` pairs (a, b)
    only if its pair is one of them.
    """
    print_of = F.bit_xor(F.xxhash64("node", F.lit(3)))
    groups = placed.groupBy("token").agg(
        F.min("piece").alias("least"), F.max("piece").alias("most"), F.count(F.lit(1)).alias("count"), print_of.alias("print"),
        F.min("node").alias("low"), F.max("node").alias("high"),
    )
    groups = groups.where((F.col("count") >= (3 if known is None else 2)) & (F.col("least") < F.col("most")))
    if known is not None:
        settled = known.select(F.lit(2).cast("long").alias("count"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        groups = groups.join(settled.distinct(), ["count", "low", "high"], "left_anti")
    chosen = groups.groupBy("print", "count").agg(F.min("token").alias("token")).select("token")
    return placed.join(chosen, "token").select(F.col("token").alias("group"), "node", "n", "piece")


def similar_components(docs: DataFrame, link: Link = Link()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id of the row's component.
    """
    work = Workspace(docs.sparkSession, "parity")
    described = work.save(describe(docs, link), "described")
    rows = described.where("gram is null").select("doc_id", "node", "n")
    nodes = work.save(
        described.where("gram is null and n > 0").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")),
        "nodes",
    )
    common = common_grams(described, link)

    # groups of nodes that publish the same cell
    cells = published_cells(docs, common, link)
    by_token = Window.partitionBy("token")
    grouped = (
        cells.withColumn("least", F.min("node").over(by_token)).withColumn("most", F.max("node").over(by_token))
        .withColumn("members", F.count(F.lit(1)).over(by_token))
        .where("least < most").select("token", "node", "n", "members").distinct()
    )
    grouped = work.save(grouped, "grouped")

    # every member with its group's hub, the member that meets most others
    score = grouped.groupBy("node").agg(F.sum("members").alias("score"))
    hub = F.max(F.struct("score", "node", "n")).over(by_token)
    spokes = grouped.join(score, "node").withColumn("hub", hub).where(F.col("hub.node") != F.col("node"))
    spokes = spokes.select(
        F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"), F.col("node").alias("b"), F.col("n").alias("n_b")
    ).distinct()
    near = work.save(plausible(spokes, nodes, link), "near")

    # groups that their hubs don't hold together, in blocks
    stars = near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("piece"))
    starred = in_pieces(grouped.select("token", "node", "n"), stars)
    found = work.save(block_pairs(open_groups(starred), nodes, link), "found")
    pairs = work.save(near.unionByName(found.select("a", "b")).distinct(), "pairs")

    # verify what holds the groups together
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = work.save(sets_of(docs, nodes.select("node", "doc_id").join(ends, "node"), link), "sets")
    checked = work.save(verified(pairs, sets, link), "checked")
    labels = connected_components(checked.where("linked").select("a", "b"), work, "links")
    labels = labels.withColumnRenamed("component", "piece")

    # Groups that may still hold a link: they reported a pair before, or a hub held their members
    # together and no longer does. Of those, the pieces that sketches still join are compared by their sets.
    named = labels.select("node", F.col("piece").alias("true_piece"))
    real = work.save(starred.join(named, "node", "left").withColumn("true_piece", F.coalesce("true_piece", "node")), "real")
    broken = real.groupBy("token", "piece").agg(F.min("true_piece").alias("least"), F.max("true_piece").alias("most"))
    again = broken.where("least < most").select("token").unionByName(found.select(F.col("group").alias("token"))).distinct()
    real = real.join(again, "token").select("token", "node", "n", F.col("true_piece").alias("piece"))
    opened = work.save(open_groups(real), "opened")
    maybe = block_pairs(opened, nodes, link).select("group", F.explode(F.array("a", "b")).alias("node")).distinct()
    joined = work.save(maybe.join(opened, ["group", "node"]).select("group", "piece").distinct(), "joined")
    # groups that are left with the same pieces become one, so a set is sent once for them
    same = joined.groupBy("group").agg(F.bit_xor(F.xxhash64("piece", F.lit(4))).alias("token"))
    left = opened.join(joined.join(same, "group"), ["group", "piece"]).select("token", "node", "n", "piece").distinct()
    left = open_groups(left, checked)
    late = block_pairs(left, sets, link, exact=True).select("a", "b").distinct()

    # rows that share an id hold their nodes together
    shared = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    shared = rows.where("n > 0").join(shared.where("a < b").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    more = work.save(late.unionByName(shared.where("a <> b")), "more")
    if not more.isEmpty():
        side = lambda c: labels.select(F.col("node").alias(c), F.col("piece").alias(f"{c}_piece"))
        joined = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
            F.coalesce("a_piece", "a").alias("a"), F.coalesce("b_piece", "b").alias("b")
        )
        outer = connected_components(joined, work, "pieces").withColumnRenamed("node", "piece")
        inner = labels.unionByName(outer.select(F.col("piece").alias("node"), "piece")).distinct()
        labels = inner.join(outer, "piece", "left").groupBy("node").agg(F.min(F.coalesce("component", "piece")).alias("piece"))

    named = work.save(in_pieces(nodes.select("node", "doc_id"), labels).select("node", "doc_id", "piece"), "named")
    names = named.groupBy("piece").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "piece").select("node", "component_id")
    out = rows.join(named.withColumnRenamed("node", "of"), (rows["n"] > 0) & (rows["node"] == F.col("of")), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    out = work.save(out, "components")
    work.keep_only("components")
    return out


def keep_one(docs: DataFrame, link: Link = Link()) -> DataFrame:
    """``docs`` with one row for each component: the first of its smallest id.

    Rows without any n-gram and rows without an id stay.
    """
    found = similar_components(docs, link)
    gone = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    without = F.col("doc_id").isNull()
    left = docs.join(gone, "doc_id", "left_anti")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    passes = without | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    number = free_name(docs, "_same_id")
    worded = left.where(~passes).withColumn(number, again).where(F.col(number) == 1).drop(number)
    return left.where(passes).unionByName(worded)


#: Set sizes and components of ``documents`` for DuckDB. Copies are one class, as in the operator; classes
#: that share an n-gram are compared by counts of shared n-grams.
SQL = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case
    when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as grams
  from texts
), classes as (
  select min(doc_id) as class, len(grams) as n, grams, list(doc_id) as ids from sets where len(grams) > 0 group by grams
), entries as (
  select class, n, unnest(grams) as gram from classes
), links as (
  select a.class as a, b.class as b from entries a join entries b on a.gram = b.gram and a.class < b.class
  where 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.class, b.class, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), sides as (
  select a, b from links union all select b, a from links
), reach as (
  select class, class as other from classes
  union
  select r.class, l.b from reach r join sides l on l.a = r.other
), named as (
  select class, min(other) as component_id from reach group by class
), members as (
  select unnest(c.ids) as doc_id, component_id from classes c join named using (class)
)
select s.doc_id, len(s.grams) as n_shingles, coalesce(m.component_id, s.doc_id) as component_id
from sets s left join members m using (doc_id)
"""

"""Token id files in Re-Pair compression, in id order, with random access.

Texts are range-partitioned by id and sorted, encoded by the tokenizers library (each distinct
piece of the pre-tokenizer once), closed with an end id, and cut into shards of whole documents.
A shard's ids are compressed by a grammar: the most frequent pairs of neighbours
are replaced by new symbols, round after round until no pair occurs often enough to pay for its
rule, with all pairs of a round that don't overlap replaced together. Pairs never reach over the end of a document, so every document is a run
of symbols of its own. A shard holds the rules, the length each symbol expands to, and where
documents start, so a span of ids is decoded without touching the rest.

Layout of a shard, all little-endian:
  magic b"RPR1"; uint32 documents, rules, symbols; uint64 ids;
  rules x (uint32 left, uint32 right); rules x uint32 expansion length;
  documents x uint64 first symbol; documents x uint64 first id; symbols of three bytes.
Symbols below ``VOCABULARY`` are ids; symbol VOCABULARY + r is rule r. Shards are rows of a
Parquet table (part, shard, ids of the documents, payload), since only Spark reaches every
store.

Defined cases: a null or empty text is its end id alone; rows without an id come first; rows
that share an id stay, in text order; an empty table makes no shards.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, ranges
from .mixing import _running
from .textbuf import text_slices
from .workspace import Workspace

#: Pieces that go to the library together.
LINES = 100
VOCABULARY = 1 << 16
SHARD_IDS = 1 << 20
#: A rule takes 12 bytes of a shard and saves 3 at each place, so pairs pay from four places on.
LEAST_COUNT = 4
#: A round takes the pairs with at least this share of the most frequent one's occurrences.
ROUND_SHARE = 0.25
HEAD = struct.Struct("<4sIIIQ")


class LibraryEncoder(Encoder):
    """Learns new pieces from the tokenizers library instead of the pair index."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        super().__init__(Vocabulary(path))

    def learn(self, forms: Sequence[str]) -> np.ndarray:
        """Pieces go to the library many at a time, on lines of their own.

        A line break beside a piece never changes how it is cut off or encoded, unless the
        piece holds white space other than one space in front; those go one by one.
        """
        plain = [_PLAIN.fullmatch(f) is not None for f in forms]
        lines = [i for i, p in enumerate(plain) if p]
        alone = [i for i, p in enumerate(plain) if not p]
        blocks = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        coded = self.library.encode_batch_fast(["\n".join([forms[i] for i in b]) for b in blocks], add_special_tokens=False)
        (newline,) = self.newline
        flat, lengths = [], []
        for block, e in zip(blocks, coded):
            found = np.array([*e.ids, newline], dtype=np.int32)
            cuts = np.flatnonzero(found == newline)
            if len(cuts) != len(block):
                raise ValueError("a piece was encoded with a line break of its own")
            lengths.append(np.diff(np.append(-1, cuts)) - 1)
            flat.append(found[found != newline])
        for e in self.library.encode_batch_fast([forms[i] for i in alone], add_special_tokens=False):
            flat.append(np.array(e.ids, dtype=np.int32))
            lengths.append(np.array([len(e.ids)]))
        order = np.argsort(np.array(lines + alone), kind="stable")
        counts = np.concatenate(lengths)
        starts = np.append(0, np.cumsum(counts))[:-1]
        self.ids = np.concatenate([self.ids, np.concatenate(flat)[ranges(starts[order], counts[order])]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[order])])
        return counts[order]


#: Pieces without white space but for one space in front.
_PLAIN = re.compile(r" ?\S+")


@functools.lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class _Growing:
    """A flat array that grows at its end, by half of its size at a time."""

    def __init__(self, kind: type, room: int = 1 << 16):
        self.room, self.size = np.empty(room, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.empty(max(size, len(self.room) * 3 // 2), dtype=self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : size] = values
        self.size = size

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class Pairs:
    """The pairs of neighbours of a shard, how often each occurs, and where.

    A pair is counted once, when its younger symbol is made: all its occurrences begin in that
    round, and later rounds only end some. So a pair that begins too rare stays too rare.
    """

    def __init__(self, room: int) -> None:
        self._keys, self._counts = _Growing(np.int64), _Growing(np.int32)
        self._starts, self._sizes = _Growing(np.int64), _Growing(np.int32)
        self._places = _Growing(np.int32, room)
        self.open = np.zeros(0, dtype=np.int32)

    keys = property(lambda self: self._keys.values)
    counts = property(lambda self: self._counts.values)
    starts = property(lambda self: self._starts.values)
    sizes = property(lambda self: self._sizes.values)
    places = property(lambda self: self._places.values)

    def add(self, at: np.ndarray, left: np.ndarray, right: np.ndarray, pair: np.ndarray) -> None:
        """Take in the new pairs that begin at ``at``, and write their numbers to ``pair``."""
        if not len(at):
            return
        wide, deep = int(max(left.max(), right.max())).bit_length(), int(at.max()).bit_length()
        key = left.astype(np.int64) << wide | right
        if 2 * wide + deep < 64:  # one sort of plain numbers is several times faster than its order
            key = np.sort(key << deep | at)
            at = key & ((1 << deep) - 1)
            key >>= deep
        else:
            order = np.argsort(key)
            key, at = key[order], at[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        often = sizes >= LEAST_COUNT
        first, sizes_kept = first[often], sizes[often]
        at, key, sizes = at[np.repeat(often, sizes)], key[first], sizes_kept
        numbers = np.arange(len(self.keys), len(self.keys) + len(key), dtype=np.int32)
        pair[at] = np.repeat(numbers, sizes)
        self._starts.extend(len(self.places) + np.cumsum(sizes) - sizes)
        self._keys.extend(key >> wide << 32 | key & ((1 << wide) - 1))
        self._counts.extend(sizes)
        self._sizes.extend(sizes)
        self._places.extend(at)
        self.open = np.append(self.open, numbers)

    def frequent(self) -> np.ndarray:
        """The pairs of this round, the most frequent first; none when no pair pays any more."""
        counts = self.counts[self.open]
        pays = counts >= LEAST_COUNT
        self.open, counts = self.open[pays], counts[pays]
        best = self.open[counts >= counts.max(initial=0) * ROUND_SHARE]
        return best[np.lexsort((self.keys[best], -self.counts[best]))]


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of ``at`` to take, so that of a run of overlapping pairs it is every other one."""
    starts = np.append(True, after[at[:-1]] != at[1:])[: len(at)]
    number = np.arange(len(at))
    return (number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0


def compress(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, first symbol of each document) of documents ``ids[bounds[i]:bounds[i+1]]``.

    Rounds go on until no pair has ``LEAST_COUNT`` occurrences that don't overlap. A round costs
    what it replaces: symbols are linked, and only pairs beside a new symbol are counted anew.
    """
    n = len(ids)
    # 32 bits throughout: the arrays are gone through at random, and half the bytes fit the cache better
    symbols = np.append(ids, 0).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # n: nothing there
    filled = np.diff(bounds) > 0
    after[np.append(bounds[1:][filled] - 1, n)] = n
    before[np.append(bounds[:-1][filled], n)] = n
    pair = np.full(n + 1, -1, dtype=np.int32)
    alive = np.append(np.ones(n, dtype=bool), False)
    new = np.append(np.zeros(n, dtype=bool), True)
    none = np.iinfo(np.int32).max
    rank = np.full(n + 1, none, dtype=np.int32)
    pairs = Pairs(n)
    at = np.flatnonzero(after < n)
    pairs.add(at, symbols[at], symbols[at + 1], pair)
    rules: list[np.ndarray] = []
    made = 0
    while len(chosen := pairs.frequent()):
        sizes = pairs.sizes[chosen]
        at = pairs.places[ranges(pairs.starts[chosen], sizes)]
        number = np.repeat(np.arange(len(chosen)), sizes)
        valid = np.flatnonzero(pair[at] == chosen[number])
        both = np.sort(at[valid].astype(np.int64) << 32 | number[valid])
        at, number = both >> 32, both & 0xFFFFFFFF
        # of pairs that overlap the more frequent goes first; the others wait for a later round
        rank[at] = number
        low = (number <= rank[before[at]]) & (number <= rank[after[at]])
        rank[at] = none
        twins = symbols[at] == symbols[after[at]]
        if twins.any():  # runs of one symbol have fewer pairs that don't overlap than pairs
            own = number[twins]
            apart = np.bincount(own[_alternate(at[twins], after)], minlength=len(chosen))
            pairs.counts[chosen[own[apart[own] < LEAST_COUNT]]] = 0
        at, number = at[low], number[low]
        apart = _alternate(at, after)
        at, number = at[apart], number[apart]
        pays = np.bincount(number, minlength=len(chosen)) >= LEAST_COUNT
        at, number = at[pays[number]], number[pays[number]]
        if not len(at):
            continue
        keys = pairs.keys[chosen[pays]]
        rules.append(np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1))
        gone, ahead = after[at].astype(np.int64), before[at].astype(np.int64)
        alive[gone] = False
        ended = np.concatenate([at, gone, ahead[alive[ahead]]])
        lost = pair[ended]
        np.subtract(pairs.counts, np.bincount(lost[lost >= 0], minlength=len(pairs.counts)), out=pairs.counts, casting="unsafe")
        pair[ended] = -1
        symbols[at] = VOCABULARY + made + (np.cumsum(pays) - 1)[number]
        made += len(keys)
        after[at] = after[gone]
        before[after[at]] = at
        before[n] = n
        new[at] = True
        ahead = before[at].astype(np.int64)
        begun = np.concatenate([at, ahead[~new[ahead]]])
        new[at] = False
        begun = begun[after[begun] < n]
        pairs.add(begun, symbols[begun], symbols[after[begun]], pair)
    starts = np.append(0, np.cumsum(alive[:-1]))[bounds[:-1]]
    return symbols[alive], np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), starts


def expansions(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for; rules refer to earlier ones only."""
    lengths = np.zeros(len(rules), dtype=np.int64)
    known = np.ones(VOCABULARY + len(rules), dtype=np.int64)
    done = 0
    while done < len(rules):  # a round of rules refers to the rounds before it
        block = rules[done:]
        ready = int(np.argmax(np.append((block >= VOCABULARY + done).any(axis=1), True)))
        lengths[done : done + ready] = known[block[:ready]].sum(axis=1)
        known[VOCABULARY + done : VOCABULARY + done + ready] = lengths[done : done + ready]
        done += ready
    return lengths


def write_shard(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    symbols, rules, starts = compress(ids, bounds)
    if len(rules) >= (1 << 24) - VOCABULARY:
        raise ValueError("a shard has more rules than three bytes can name")
    return b"".join(
        [
            HEAD.pack(b"RPR1", len(bounds) - 1, len(rules), len(symbols), len(ids)),
            rules.astype("<u4").tobytes(),
            expansions(rules).astype("<u4").tobytes(),
            starts.astype("<u8").tobytes(),
            bounds[:-1].astype("<u8").tobytes(),
            symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(),
        ]
    )


class Shard:
    """A shard opened for reading."""

    def __init__(self, payload: bytes):
        magic, self.documents, n_rules, n_symbols, self.n_ids = HEAD.unpack_from(payload)
        if magic != b"RPR1":
            raise ValueError("not a token shard")
        at = HEAD.size

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at).astype(np.int64)
            at += count * np.dtype(kind).itemsize
            return out

        self.rules = read("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = np.ones(VOCABULARY + n_rules, dtype=np.int64)
        self.lengths[VOCABULARY:] = read("<u4", n_rules)
        self.first_symbol = np.append(read("<u8", self.documents), n_symbols)
        self.first_id = np.append(read("<u8", self.documents), self.n_ids)
        wide = np.zeros((n_symbols, 4), dtype=np.uint8)
        wide[:, :3] = np.frombuffer(payload, np.uint8, 3 * n_symbols, at).reshape(-1, 3)
        self.symbols = wide.view("<u4").ravel().astype(np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for; all rules of one depth are opened at once."""
        ends = np.cumsum(self.lengths[symbols])
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        place = ends - self.lengths[symbols]
        while len(symbols):
            rule = symbols >= VOCABULARY
            out[place[~rule]] = symbols[~rule]
            left, right = self.rules[symbols[rule] - VOCABULARY].T
            place = place[rule]
            symbols, place = np.concatenate([left, right]), np.concatenate([place, place + self.lengths[left]])
        return out

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.first_symbol[i] : self.first_symbol[i + 1]])

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, opening only the symbols that cover them."""
        if not hasattr(self, "ends"):
            self.ends = np.cumsum(self.lengths[self.symbols])
        low = int(np.searchsorted(self.ends, start, side="right"))
        high = int(np.searchsorted(self.ends, stop, side="left")) + 1
        base = int(self.ends[low - 1]) if low else 0
        return self.expand(self.symbols[low:high])[start - base : stop - base]


def write_tokens(docs: DataFrame, path: str, target: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) to ``target`` and return them as a table."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        part = TaskContext.get().partitionId()
        number, owners, held, size = 0, [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], dtype=np.int64)
            payload = write_shard(np.concatenate(held), np.append(0, np.cumsum(lengths)))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                    pa.array([owners], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                names=["part", "shard", "n_ids", "doc_ids", "payload"],
            )

        for batch in source:
            for piece in text_slices(batch.column(1), max_bytes=1 << 22):
                ids, bounds = coder.encode([piece.text(i).decode() for i in range(piece.n)])
                for i, doc in enumerate(batch.column(0)[piece.rows].to_pylist()):
                    owners.append(doc)
                    held.append(np.append(ids[bounds[i] : bounds[i + 1]], np.int32(end_id)))
                    size += len(held[-1])
                    if size >= shard_ids:
                        yield shard()
                        number, owners, held, size = number + 1, [], [], 0
        if held:
            yield shard()

    kind = docs.select(F.col("doc_id").cast("long"), "text")
    dealt = kind.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    schema = "part int, shard long, n_ids long, doc_ids array<long>, payload binary"
    dealt.mapInArrow(batches, schema).write.mode("overwrite").parquet(target)
    return docs.sparkSession.read.schema(schema).parquet(target)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it, by running sums over parts and shards.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part, number, owners, payload in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(payload)
                ids = shard.expand(shard.symbols).astype("<u4")
                firsts = shard.first_id.tolist()
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(firsts[:-1], firsts[1:])]
                n = len(owners)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(owners, pa.int64()),
                        pa.array(shard.first_id[:-1]), pa.array(np.diff(shard.first_id)), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = files.select("part", "shard", "doc_ids", "payload").mapInArrow(
        batches, "part int, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    ordered = _running(files.select("part", "shard", "n_ids"), [], "part", [F.col("shard")], "n_ids")
    ordered = ordered.select("part", "shard", (F.col("running") - F.col("n_ids")).alias("before"))
    return read.join(ordered, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` below the shared folder and read the documents back."""
    work = Workspace(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, f"{work.folder}/files", end_id))

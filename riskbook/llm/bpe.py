"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pieces of a partition's texts are laid out in one symbol array. An index maps
each mergeable pair to all its positions there. The active ranks (those with positions) are
taken in ascending order; a rank's pairs merge at all their positions at once, and the pairs
that arise beside them are added to the lists of their ranks. A pair with a merged symbol in
it always has a higher rank, so one ascending run gives the usual left-to-right result.

Nulls encode like empty texts, to no ids. The end-of-text string in a text becomes its own
id, as in the tokenizers library's default. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretoken import Pieces
from .textbuf import text_slices

#: Distinct pieces that a worker remembers before it starts afresh.
MEMORY = 1 << 21


def byte_signs() -> dict[int, str]:
    """The printable sign for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab, merges = content["model"]["vocab"], content["model"]["merges"]
        signs = byte_signs()
        of_sign = {c: b for b, c in signs.items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.first_ids = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_sign[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(left << 32 | right, kind="stable")
        # the key at the end is above all pairs, so that a search always lands on an entry
        self.keys = np.append((left << 32 | right)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, -1).astype(np.int32)
        self.pairs = np.stack([left, right], axis=1).tolist()
        lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.byte_starts = np.append(0, np.cumsum(lengths))
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.keys.searchsorted(key)
        found = self.keys[at] == key
        ranks = self.ranks[at]
        ranks[~found] = -1
        return ranks

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.token_bytes))]
        return self.all_bytes[ranges(self.byte_starts[ids], np.diff(self.byte_starts)[ids])].tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all ranges, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def _lists(ranks: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by rank; pairs without a rank are left out."""
    keep = (ranks >= 0).nonzero()[0]
    if not len(keep):
        return
    ranks, positions = ranks[keep], positions[keep]
    order = ranks.argsort(kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist(), len(ranks)]
    for r, low, high in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
        yield r, positions[low:high]


def merge_all(vocab: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces ``data[bounds[i]:bounds[i + 1]]`` in a row, and each piece's number of ids."""
    n = len(data)
    symbol = np.append(vocab.first_ids[data], -1)  # the last entry stands for "no neighbour"
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    after[bounds[1:][bounds[1:] > 0] - 1] = n
    before[bounds[:-1][bounds[:-1] < n]] = n
    after[n] = before[n] = n
    index: dict[int, list[np.ndarray]] = {}
    left = np.flatnonzero(after[:n] < n)
    for r, at in _lists(vocab.rank(symbol[left], symbol[after[left]]), left):
        index[r] = [at]
    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = vocab.pairs[r]
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]  # gone ones hold no symbol
        if a == b and len(at) > 1:
            at = _every_other(np.unique(at), after)
        if not len(at):
            continue
        gone = after[at]
        symbol[gone] = -2
        symbol[at] = vocab.merged[r]
        beyond = after[gone]
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        ahead = before[at]
        new = np.concatenate([at[beyond < n], ahead[ahead < n]])
        if a == b:
            new = np.unique(new)
        for rank, positions in _lists(vocab.rank(symbol[new], symbol[after[new]]), new):
            if rank in index:
                index[rank].append(positions)
            else:
                index[rank] = [positions]
                heapq.heappush(active, rank)
    alive = symbol[:n] >= 0
    starts = np.append(0, np.cumsum(alive))
    return symbol[:n][alive], starts[bounds[1:]] - starts[bounds[:-1]]


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """In chains of overlapping pairs of equal symbols, the first, third, fifth, ... pair."""
    chained = np.append(False, after[at[:-1]] == at[1:])
    number = np.arange(len(at))
    chain_start = np.maximum.accumulate(np.where(chained, 0, number))
    return at[(number - chain_start) % 2 == 0]


class Encoder:
    """Encodes texts; remembers the ids of pieces it has seen, up to ``MEMORY`` of them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        # hashes of the pieces seen, ascending, and the number of each in the order of learning
        self.known = np.zeros(0, dtype=np.uint64)
        self.numbers = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def learn(self, forms: Sequence[str]) -> np.ndarray:
        """Ids of new pieces, appended; returns how many each has."""
        coded = [f.encode() for f in forms]
        bounds = np.append(0, np.cumsum([len(c) for c in coded])).astype(np.int64)
        ids, counts = merge_all(self.vocab, np.frombuffer(b"".join(coded), dtype=np.uint8), bounds)
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        return counts

    def entries(self, forms: np.ndarray, spelled: Callable[[list[int]], list[str]]) -> np.ndarray:
        """The number of each distinct form (a hash), after learning the new ones by their spelling."""
        order = np.argsort(forms)
        asked = forms[order]
        place = np.searchsorted(self.known, asked)
        found = place < len(self.known)
        found[found] = self.known[place[found]] == asked[found]
        out = np.empty(len(forms), dtype=np.int64)
        out[order[found]] = self.numbers[place[found]]
        new = order[~found]
        if len(new):
            self.learn(spelled(new.tolist()))
            out[new] = len(self.known) + np.arange(len(new))
            self.known = np.insert(self.known, place[~found], asked[~found])
            self.numbers = np.insert(self.numbers, place[~found], out[new])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (and the last end)."""
        parts, owner, special = texts, None, {}
        if any(s in t for s in self.vocab.special for t in texts):
            parts, owner, special = self._around_special(texts)
        pieces = Pieces(parts)
        numbers, forms, first = pieces.distinct()
        if len(self.known) + len(forms) > MEMORY:
            self.forget()
        entry = self.entries(forms, lambda new: [pieces.form(first[i]) for i in new])[numbers]
        counts = np.diff(self.starts)[entry]
        ids = self.ids[ranges(self.starts[entry], counts)]
        ends = np.append(0, np.cumsum(counts))[pieces.bounds]
        if owner is None:
            return ids, ends
        out, lengths = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(owner):
            chunk = np.array([special[i]], np.int32) if i in special else ids[ends[i] : ends[i + 1]]
            out.append(chunk)
            lengths[text] += len(chunk)
        return np.concatenate(out), np.append(0, np.cumsum(lengths))

    def _around_special(self, texts: list[str]) -> tuple[list[str], list[int], dict[int, int]]:
        """Texts cut at special strings (which become empty parts with an id of their own)."""
        parts: list[str] = []
        owner: list[int] = []
        special: dict[int, int] = {}
        longest_first = sorted(self.vocab.special, key=len, reverse=True)
        pattern = re.compile("|".join(map(re.escape, longest_first)))
        for i, text in enumerate(texts):
            end = 0
            for hit in pattern.finditer(text):  # one walk, however many there are
                special[len(parts) + 1] = self.vocab.special[hit.group()]
                parts += [text[end : hit.start()], ""]
                owner += [i, i]
                end = hit.end()
            parts.append(text[end:])
            owner.append(i)
        return parts, owner, special


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(vocabulary(path))



OUTPUTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
}


def encode_documents(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), outputs: Sequence[str] = tuple(OUTPUTS), text: str = "text"
) -> DataFrame:
    """The columns ``keep`` and ``outputs`` of every row; the decoded text is made from the ids.

    ``ids_sha256`` is the digest of the decimal ids joined by commas. Runs map-side, a row's
    text in one piece, in slices of about 4 MB. Repeated rows stay.
    """
    keep = list(keep)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        decimal = np.array([str(i).encode() for i in range(len(coder.vocab.token_bytes))], dtype=object)
        for batch in source:
            for part in text_slices(batch.column(len(keep)), max_bytes=1 << 22):
                ids, bounds = coder.encode([part.text(i).decode() for i in range(part.n)])
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                made = {"n_tokens": pa.array(np.diff(bounds), pa.int64())}
                if "ids" in outputs:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                if "ids_sha256" in outputs:
                    said = decimal[ids].tolist()
                    made["ids_sha256"] = pa.array(
                        [hashlib.sha256(b",".join(said[a:b])).hexdigest() for a, b in spans], pa.string()
                    )
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = [coder.vocab.decode(ids[a:b]).decode("utf-8", "replace") for a, b in spans]
                    made["decoded"] = pa.array(decoded, pa.string())
                    made["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i)[part.rows] for i in range(len(keep))] + [made[o] for o in outputs],
                    names=[*keep, *outputs],
                )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, text).mapInArrow(batches, ", ".join(kinds + [f"{o} {OUTPUTS[o]}" for o in outputs]))

"""Toxic sentences by a support vector machine over a subsequence string kernel.

Two words are alike as far as they share letter triples in order, gaps allowed: a triple that
spans s letters weighs ``DECAY ** s`` (spans up to ``SPAN``), so an insult with letters put in
between still resembles itself. Everything but letters is passed over (with the usual
look-alike signs read as letters), and neighbouring words of one letter are read as one
word, so spaced-out spellings lose nothing. The kernel of words is normalised and taken to a power; the kernel of
sentences is its sum over pairs of words. A Nyström map with landmark words makes
it a short vector, on which a linear machine is trained from labelled sentences; in a toxic
document only its highest-scoring sentence must be toxic. A logistic curve, fitted on the
training documents, brings the margins of a document's highest sentences to 0..1.

Fitting uses a bounded sample of labelled rows (``Options.most_rows``), chosen by a hash of
their ids; scoring runs map-side on every whole text.

Defined cases: null, empty and letterless texts have one sentence with an all-zero vector;
without both labels in the training rows every score is the training share of toxic rows (0.0
if there is none); null labels are left out; repeated rows are scored each.
"""

from __future__ import annotations

import ctypes
import gc
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ranges
from .textbuf import Slice, _random, span_hashes, text_slices

DECAY, SPAN, POWER = 0.7, 6, 3
#: Signs read as letters (fixed values). Other bytes outside a-z are passed over, all letters
#: beyond ASCII are one sign, and two more signs mark where a word starts and ends.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
STRANGE, START, END, SKIP = 26, 27, 28, 255
SIGNS = 29

CODE = np.full(256, SKIP, dtype=np.uint8)
for _c in range(26):
    CODE[ord("a") + _c] = CODE[ord("A") + _c] = _c
for _a, _b in LOOKALIKES.items():
    CODE[ord(_a)] = ord(_b) - ord("a")
CODE[0xC0:] = STRANGE
#: Look-alikes at a word's end are mostly punctuation.
ENDING = np.zeros(256, dtype=bool)
ENDING[[ord(c) for c in "!"]] = True
PATTERNS = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]
SENTENCE_WORDS = 64
#: Sentences of a document that its score hangs on.
TOP = 3
#: Bytes of text that fitting and scoring work on at once.
FIT_BYTES = SCORE_BYTES = 1 << 19
ENDS_SENTENCE = np.zeros(256, dtype=bool)
ENDS_SENTENCE[[ord(c) for c in ".!?"]] = True


def _triples(codes: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(position of the first letter, number of the triple, weight) for each gap pattern."""
    n = len(codes)
    wide = codes.astype(np.int32)
    for i, j in PATTERNS:
        m = n - i - j
        if m <= 0:
            continue
        at = np.flatnonzero(word[:m] == word[i + j :])
        yield at, (wide[at] * SIGNS + wide[at + i]) * SIGNS + wide[at + i + j], DECAY ** (i + j + 1)


def _owned_triples(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(number of the word, number of the triple, weight) for each gap pattern."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at, triple, weight in _triples(codes, owner):
        yield owner[at], triple, weight


#: Longer words (in signs) add up their repeated triples exactly; shorter ones hold few.
LONG = 48

#: Places and squared weights of the gap patterns: a word of n signs has n - reach triples of each.
_REACH = np.array([i + j for i, j in PATTERNS])
_SQUARES = DECAY ** (2.0 * (_REACH + 1))


def norms(sizes: np.ndarray) -> np.ndarray:
    """Length of each word's triple vector by its number of signs, repeats not merged; 1 without triples."""
    forms, number = np.unique(sizes, return_inverse=True)
    squared = (np.maximum(0, forms[:, None] - _REACH) * _SQUARES).sum(axis=1)
    return np.sqrt(np.where(squared > 0, squared, 1.0))[number]


_SIGN_HASH = _random(256, 11)


class Words:
    """Distinct words as sign codes: word w is ``codes[bounds[w]:bounds[w + 1]]``, marks included."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds = codes, bounds
        self.sizes = np.diff(bounds)
        self.norms = norms(self.sizes)
        long = np.flatnonzero(self.sizes > LONG)
        if len(long):
            self.norms[long] = self._merged_norms(long)

    def _merged_norms(self, numbers: np.ndarray) -> np.ndarray:
        """Lengths of some words' triple vectors with repeated triples added up."""
        sizes = self.sizes[numbers]
        codes = self.codes[ranges(self.bounds[numbers], sizes)]
        found = [(owner, triple, weight) for owner, triple, weight in _owned_triples(codes, sizes)]
        key = np.concatenate([owner.astype(np.int64) * SIGNS**3 + triple for owner, triple, _ in found])
        weight = np.concatenate([np.full(len(triple), w) for _, triple, w in found])
        forms, number = np.unique(key, return_inverse=True)
        total = np.bincount(number, weight)
        return np.sqrt(np.bincount(forms // SIGNS**3, total * total, minlength=len(numbers)))

    def pick(self, numbers: np.ndarray) -> "Words":
        sizes = self.sizes[numbers]
        return Words(self.codes[ranges(self.bounds[numbers], sizes)], np.append(0, np.cumsum(sizes)))

    def keys(self) -> list[bytes]:
        flat = self.codes.tobytes()
        return [flat[a:b] for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]

    @staticmethod
    def of(keys: list[bytes]) -> "Words":
        return Words(np.frombuffer(b"".join(keys), np.uint8), np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int64))


class Sentences:
    """The sentences of a slice's rows, each a bag of distinct words.

    ``number[k]`` is the distinct word of running word k, ``sentence[k]`` its sentence, and
    ``rows`` the row of each sentence.
    """

    def __init__(self, part: Slice):
        data, words = part.data, part.words()
        starts, ends = words.starts, words.ends
        n = len(starts)
        code = CODE[data]
        last = ends - 1
        code[last[ENDING[data[last]] & (ends - starts > 1)]] = SKIP
        solid = code != SKIP
        total = np.append(0, np.cumsum(solid))
        letters = total[ends] - total[starts]
        rows = words.rows()
        # neighbouring words of one letter are one spaced-out word
        lone = letters == 1
        joined = np.zeros(n, dtype=bool)
        joined[1:] = lone[1:] & lone[:-1] & (rows[1:] == rows[:-1])
        opening = np.flatnonzero(~joined)
        # a sentence ends after . ! ? or a line, and after SENTENCE_WORDS words
        lines = np.append(0, np.cumsum(data == 0x0A))
        first = np.ones(n, dtype=bool)
        first[1:] = (
            ENDS_SENTENCE[data[last[:-1]]] | (lines[starts[1:]] > lines[last[:-1]]) | (rows[1:] != rows[:-1])
        )
        if n:
            run_start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            first |= (np.arange(n) - run_start) % SENTENCE_WORDS == 0
        self.rows = rows[first]
        self.sentence = (np.cumsum(first) - 1)[opening]
        self.n = part.n
        # codes of the joined words, between marks
        begin = total[starts[opening]] if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, total[-1])) if n else np.zeros(0, np.int64)
        flat = code[solid]
        hashes = span_hashes(_SIGN_HASH[flat], begin, begin + sizes)
        self.number, forms = pd.factorize(hashes)
        self.hashes = forms
        where = np.empty(len(forms), dtype=np.int64)
        where[self.number[::-1]] = np.arange(len(self.number))[::-1]
        bounds = np.append(0, np.cumsum(sizes[where] + 2))
        codes = np.empty(bounds[-1], dtype=np.uint8)
        codes[bounds[:-1]], codes[bounds[1:] - 1] = START, END
        codes[ranges(bounds[:-1] + 1, sizes[where])] = flat[ranges(begin[where], sizes[where])]
        self.words = Words(codes, bounds)


class Kernel:
    """The kernel between words and landmark words, by a sparse table over triples."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = Words.of(landmarks)
        size = len(landmarks)
        dense = np.zeros((SIGNS**3, size), dtype=np.float32)
        owner = np.repeat(np.arange(size), self.landmarks.sizes)
        for at, triple, weight in _triples(self.landmarks.codes, owner):
            np.add.at(dense, (triple, owner[at]), weight / self.landmarks.norms[owner[at]])
        used = np.flatnonzero(dense.any(axis=1))
        self.slot = np.full(SIGNS**3, -1, dtype=np.int32)
        self.slot[used] = np.arange(len(used))
        self.table = dense[used]

    def to(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words that share a triple with a landmark, their kernel to each landmark)."""
        owner_of = np.repeat(np.arange(len(words.sizes)), words.sizes)
        owners, slots, weights = [], [], []
        for at, triple, weight in _triples(words.codes, owner_of):
            slot = self.slot[triple]
            hit = np.flatnonzero(slot >= 0)
            owners.append(owner_of[at[hit]])
            slots.append(slot[hit])
            weights.append(np.full(len(hit), weight, dtype=np.float32))
        if not sum(map(len, owners)):
            return np.zeros(0, np.int64), np.zeros((0, self.table.shape[1]), np.float32)
        owner, slot, weight = map(np.concatenate, (owners, slots, weights))
        order = np.argsort(owner, kind="stable")
        owner, slot, weight = owner[order], slot[order], weight[order]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        found = owner[first]
        out = np.empty((len(found), self.table.shape[1]), dtype=np.float32)
        ends = np.append(first[1:], len(owner))
        low = 0
        while low < len(found):  # bounded blocks of the long list of shared triples
            high = min(max(low + 1, int(np.searchsorted(first, first[low] + 100_000))), len(found))
            block = slice(first[low], ends[high - 1])
            out[low:high] = np.add.reduceat(self.table[slot[block]] * weight[block, None], first[low:high] - first[low], axis=0)
            low = high
        out /= words.norms[found][:, None].astype(np.float32)
        return found, np.minimum(out, 1.0) ** POWER

    def dense(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.sizes), self.table.shape[1]))
        found, k = self.to(words)
        out[found] = k
        return out

    def gram(self) -> np.ndarray:
        """The kernel among the landmarks."""
        gram = self.dense(self.landmarks)
        return (gram + gram.T) / 2


@dataclass
class Machine:
    """A fitted scorer: sentence margin = kernel to the landmarks @ ``alpha`` + ``bias``."""

    landmarks: list[bytes]
    alpha: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def margins(self, part: Slice, kernel: Kernel) -> np.ndarray:
        """The ``TOP`` highest sentence margins of each row."""
        x = Sentences(part)
        found, k = kernel.to(x.words)
        weight = np.zeros(len(x.words.sizes))
        weight[found] = k @ self.alpha
        sentences = self.bias + np.bincount(x.sentence, weight[x.number], minlength=len(x.rows))
        return top_margins(sentences, x.rows, part.n, self.bias)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.offset, -30, 30)))


@dataclass(frozen=True)
class Options:
    """``most_rows`` bounds the labelled sample; landmarks are letters-only words of its toxic texts.

    Landmarks are chosen among the ``most_leaning`` words that toxic texts prefer most, and the
    ``most_near`` words most like them of the ``most_usual`` most frequent others.
    """

    most_rows: int = 4000
    most_leaning: int = 2000
    most_usual: int = 20_000
    most_near: int = 1000
    landmarks: int = 48
    least_docs: int = 4
    rounds: int = 5
    penalty: float = 1e-3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that must not be learned from: crc32 of the id as text, remainder 0 by five."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, options: Options) -> DataFrame:
    """(text, toxic) of at most ``most_rows`` labelled rows, half of them toxic if there are so many.

    Rows come in the order of a hash of their ids, so the sample doesn't hang on layout.
    """
    marked = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    half = options.most_rows // 2
    order = [F.xxhash64(F.col("doc_id"), F.lit(8)), F.col("doc_id")]
    chosen = [marked.where(F.col("toxic") == t).orderBy(*order).limit(half) for t in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    # of rows that share an id one counts, the first by a hash of its text: a task passes on one an id
    first = F.min_by("text", F.struct(F.xxhash64("text"), F.coalesce("text", F.lit(""))))
    return rows.groupBy("doc_id").agg(first.alias("text"), F.max("toxic").alias("toxic"))


def choose_landmarks(texts: list[str], toxic: np.ndarray, options: Options) -> list[bytes]:
    """Words that toxic texts hold far more often than others, and the others' words most like them.

    Words that resemble one chosen before add nothing and are passed over.
    """
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    seen: list[list[np.ndarray]] = [[], []]  # hashes of the distinct words of each text, by label
    base = 0
    for part in text_slices(pa.array(texts, pa.string()), FIT_BYTES):
        x = Sentences(part)
        pairs = pd.DataFrame({"row": x.rows[x.sentence], "word": x.number}).drop_duplicates()
        marks = toxic[pairs["row"].to_numpy() + base]
        for t in (0, 1):
            seen[t].append(x.hashes[pairs["word"].to_numpy()[marks == t]])
        base += part.n
    times = [
        pd.Series(n, index=h)
        for h, n in (np.unique(np.concatenate(s), return_counts=True) for s in seen)
    ]
    # only words of several texts are looked at by name
    several = {h for t in times for h in t.index[t.to_numpy() >= options.least_docs].tolist()}
    names: dict[int, bytes] = {}
    for part in text_slices(pa.array(texts, pa.string()), FIT_BYTES):
        x = Sentences(part)
        new = [i for i, h in enumerate(x.hashes.tolist()) if h in several and h not in names]
        names.update(zip(x.hashes[new].tolist(), x.words.pick(np.array(new, dtype=np.int64)).keys()))
    clean, bad = ({names[h]: int(n) for h, n in t.items() if h in names} for t in times)
    clean, bad = Counter(clean), Counter(bad)

    def lean(w: bytes) -> float:
        a, b = bad[w] / n1, clean[w] / n0
        return (a - b) / np.sqrt((a + b) / 2 * (1 / n1 + 1 / n0))

    often = [w for w, c in bad.items() if c >= options.least_docs and 5 <= len(w) <= 40]
    leaning = sorted((w for w in often if lean(w) > 2.5 and bad[w] / n1 > 4 * clean[w] / n0), key=lambda w: (-lean(w), w))
    chosen = _spread(leaning[: options.most_leaning], options.landmarks * 3 // 4)
    if not chosen:
        return sorted(often or [*clean, *bad], key=lambda w: (-bad[w], w))[: options.landmarks]
    usual = sorted((w for w, c in clean.items() if c >= options.least_docs and 5 <= len(w) <= 40 and lean(w) < 0), key=lambda w: (-clean[w], w))[: options.most_usual]
    like = Kernel(chosen).dense(Words.of(usual)).max(axis=1) if usual else np.zeros(0)
    near = [usual[i] for i in np.lexsort((np.arange(len(usual)), -like))[: options.most_near]]
    return _spread(chosen + near, options.landmarks)


def _spread(words: list[bytes], most: int, alike: float = 0.5) -> list[bytes]:
    """The first words of which none is much like an earlier one."""
    chosen: list[bytes] = []
    left = list(words)
    while left and len(chosen) < most:
        chosen.append(left[0])
        near = Kernel(left[:1]).dense(Words.of(left))[:, 0]
        left = [w for w, k in zip(left[1:], near[1:]) if k < alike]
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Linear machine with squared hinge loss, classes weighing the same; the last entry is the bias.

    The loss is convex and the space small, so a few Newton steps over the rows inside the
    margin solve it exactly and alike in every run. Rows are gone through in blocks.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    size = x.shape[1] + 1
    ridge = penalty * np.eye(size)
    ridge[-1, -1] = 1e-9

    def margins(w: np.ndarray) -> np.ndarray:
        return x @ w[:-1].astype(x.dtype) + w[-1]

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * margins(w)) ** 2).sum() + w @ ridge @ w)

    w = np.zeros(size)
    for _ in range(60):
        slack = 1 - y * margins(w)
        gradient, curvature = ridge @ w, ridge + 1e-10 * np.eye(size)
        inside = np.flatnonzero(slack > 0)
        for low in range(0, len(inside), 8192):
            i = inside[low : low + 8192]
            rows = np.column_stack([x[i], np.ones(len(i))]).astype(np.float64)
            gradient -= rows.T @ (weight[i] * y[i] * slack[i])
            curvature += (rows * weight[i, None]).T @ rows
        step = np.linalg.solve(curvature, gradient)
        part, now = 1.0, loss(w)
        while part > 1e-4 and loss(w - part * step) > now:
            part /= 2
        w = w - part * step
        if np.abs(part * step).max() < 1e-6:
            break
    return w


def top_margins(margin: np.ndarray, row: np.ndarray, rows: int, least: float) -> np.ndarray:
    """The highest margins of each row's sentences, highest first, filled up with ``least``."""
    order = np.lexsort((-margin, row))
    first = np.searchsorted(row[order], np.arange(rows))
    place = np.arange(len(row)) - first[row[order]]
    out = np.full((rows, TOP), least)
    keep = place < TOP
    out[row[order][keep], place[keep]] = margin[order][keep]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of P(toxic | x) by Newton's method with a slight pull to 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int], options: Options = Options()) -> Machine:
    """Train on labelled texts (a bounded number)."""
    y = np.array(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        flat = 30.0 if share else -30.0
        return Machine([], np.zeros(0), 0.0, np.zeros(TOP), flat)
    landmarks = choose_landmarks(texts, y, options)
    kernel = Kernel(landmarks)
    gram = kernel.gram()
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    vectors_of, doc_of = [], []
    base = 0
    for part in text_slices(pa.array(texts, pa.string()), FIT_BYTES):
        x = Sentences(part)
        near, k = kernel.to(x.words)
        by_word = np.zeros((len(x.words.sizes), whiten.shape[1]), dtype=np.float32)
        by_word[near] = k @ whiten
        z = np.zeros((len(x.rows), whiten.shape[1]), dtype=np.float32)
        for d in range(whiten.shape[1]):
            z[:, d] = np.bincount(x.sentence, by_word[x.number, d], minlength=len(x.rows))
        vectors_of.append(z)
        doc_of.append(x.rows + base)
        base += part.n
    z, doc = np.concatenate(vectors_of), np.concatenate(doc_of)
    vectors_of.clear()
    label = y[doc]
    chosen = np.ones(len(z), dtype=bool)
    for _ in range(options.rounds):
        w = _svm(z[chosen], np.where(label[chosen] == 1, 1.0, -1.0), options.penalty)
        margin = z @ w[:-1].astype(np.float32) + w[-1]
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, margin)
        # of a toxic document, the highest sentence; of the others, all
        chosen = (label == 0) | (margin >= best[doc])
    alpha, bias = whiten @ w[:-1], float(w[-1])
    slopes, offset = _logistic(top_margins(margin, doc, len(y), bias), y)
    return Machine(landmarks, alpha, bias, slopes, offset)


def train(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Machine:
    """Fit on the bounded labelled sample; that sample alone comes to the driver."""
    rows = training_rows(docs, labels, options).orderBy("doc_id", "text").collect()
    texts, toxic = [r["text"] or "" for r in rows], [r["toxic"] for r in rows]
    del rows
    machine = fit(texts, toxic, options)
    del texts
    _hand_back()
    return machine


def _hand_back() -> None:
    """Give freed memory back to the system, where the C library can (driver and workers live on)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def score_text(machine: Machine, text: str = "text"):
    """Column of scores of whole texts, computed in Arrow batches."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def score(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = Kernel(machine.landmarks)
        for texts in column:
            yield pa.array(_scores(machine, kernel, texts))

    return score(F.col(text))


def _scores(machine: Machine, kernel: Kernel, texts: pa.Array) -> np.ndarray:
    """Scores of an Arrow column of texts, in slices that bound the memory of a task."""
    found = [machine.scores(machine.margins(part, kernel)) for part in text_slices(texts, SCORE_BYTES)]
    return np.concatenate(found) if found else np.zeros(0)


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``limit``; dropped ones are not handed back to Spark."""
    at = docs.columns.index(text)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(machine.landmarks)
        batch = None
        for batch in source:
            yield batch.filter(pa.array(_scores(machine, kernel, batch.column(at)) < limit))
        del kernel, batch
        _hand_back()  # Spark keeps the process for later stages

    return docs.mapInArrow(batches, docs.schema)

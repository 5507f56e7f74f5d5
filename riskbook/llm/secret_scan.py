"""Secrets in texts: fixed formats, and values in credential contexts that are hard to guess.

The value behind words such as "password:" is cut into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force spans so that the product of the guesses for its
parts is smallest (a shortest path over the value's positions). Values that need many guesses
are secrets; placeholders such as "password: changeme123" need few and are no finding.

Words are ranked by how many rows of the table hold them, over the whole table, beside a
fixed list of words common in passwords; the lower rank counts. A word is a run of ``LEAST_LETTERS``
to ``MOST_LETTERS`` letters in any script, lower-cased. Values in credential contexts are left out
of the counts, so a secret that many rows repeat does not become a word. A word is ranked if at
least ``LEAST_DOCS`` rows hold it and it is among the words above the lowest count that at most ``MOST_WORDS`` words
reach. So what is sent to executors never exceeds MOST_WORDS words of MOST_LETTERS letters,
at four bytes each below 10 MB. Scripts without spaces have only their whole runs as words.

Defined cases: a null text is empty; positions count code points; spans are half-open; a
document without findings keeps its row with no spans; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: The formats to find (fixed values); the numbers are the group to measure and its least length.
FORMATS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: What every text with a finding of the second or third format holds.
HINTS = (r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
#: Credential contexts are wider than the first format; the value may hold any signs.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|credentials?|auth)["']?\x20*[:=]\x20*["']?([^\s"']+)""",
    re.I | re.A,
)
CONTEXT_HINT = r"""(?i)(pass(word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|credentials?|auth)["']?\x20*[:=]"""

#: Words often found in passwords, the most common first (fixed values; their rank is the guess count).
WORDS = (
    "password pass admin login welcome letmein qwerty dragon monkey master shadow sunshine princess "
    "football baseball superman batman trustno iloveyou hello freedom whatever ninja mustang access "
    "michael jordan hunter ranger buster soccer hockey killer george charlie thomas robert daniel "
    "summer winter spring autumn secret changeme default example test user guest root system server "
    "database oracle mysql temp demo sample placeholder token key api value your here none null true "
    "false enter insert replace string change company computer internet service account private public"
).split()
RANK = {w: i for i, w in enumerate(WORDS, 1)}
#: Words of the table: their letters, the documents that must hold them, and how many are ranked.
LEAST_LETTERS, MOST_LETTERS = 3, 24
LEAST_DOCS, MOST_WORDS = 5, 100_000
#: Words that a task counts before it passes their counts on.
HELD_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
SWAPS = str.maketrans("@4310$57!", "aaeiossti")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d)")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near[key] = {
                r[i] for dy in (-1, 0, 1) if 0 <= y + dy < len(ROWS) for r in [ROWS[y + dy]]
                for i in ((x - 1, x + 1) if dy == 0 else (x, x - dy)) if 0 <= i < len(r)
            }
    return near


NEAR = _neighbours()
#: log10 of the guesses for one brute-force sign by its kind.
SIGN_COST = {"digit": 1.0, "lower": math.log10(26), "upper": math.log10(26), "other": math.log10(33)}
#: Each part after the first costs this much more (the guesser must choose where to cut).
PART_COST = 0.5


def _kind(sign: str) -> str:
    if sign.isdigit():
        return "digit"
    return "lower" if sign.islower() else "upper" if sign.isupper() else "other"


def _run_ends(goes_on: list[bool]) -> list[int]:
    """For each position the end of the run from it on; ``goes_on[i]``: sign i + 1 continues sign i."""
    n = len(goes_on) + 1
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        ends[i] = ends[i + 1] if goes_on[i] else i + 1
    return ends


class Parts:
    """The cheap parts of a value; everything but the words is found in one pass over it."""

    def __init__(self, value: str, ranks: Mapping[str, int] = RANK):
        lower = value.lower()
        self.ranks = ranks
        self.value, self.lower = value, lower if len(lower) == len(value) else value
        self.plain = self.lower.translate(SWAPS)
        low = self.lower
        pairs = list(zip(low, low[1:]))
        self.repeats = _run_ends([a == b for a, b in zip(value, value[1:])])
        self.up = _run_ends([ord(b) - ord(a) == 1 and a.isalnum() and b.isalnum() for a, b in pairs])
        self.down = _run_ends([ord(a) - ord(b) == 1 and a.isalnum() and b.isalnum() for a, b in pairs])
        self.walks = _run_ends([b in NEAR.get(a, ()) for a, b in pairs])
        self.turns = [0, 0]  # direction changes up to each sign
        for a, c in zip(low, low[2:]):
            self.turns.append(self.turns[-1] + (c not in NEAR.get(a, ())))

    def at(self, start: int) -> Iterator[tuple[int, float, str]]:
        """(end, log10 guesses, kind) of the parts that begin at ``start``."""
        value, low = self.value, self.lower
        for end in range(start + 3, min(len(value), start + MOST_LETTERS) + 1):
            rank = self.ranks.get(low[start:end]) or 2 * self.ranks.get(self.plain[start:end], 0)
            if rank:
                yield end, math.log10(rank + 1) + 0.5 * (value[start:end] != low[start:end]), "word"
        if m := DATE.match(value, start):
            yield m.end(), math.log10(365 * 100 if m.end() - start > 4 else 100), "date"
        if (end := self.repeats[start]) - start >= 3:
            yield end, SIGN_COST[_kind(value[start])] + math.log10(end - start), "repeat"
        for end in (self.up[start], self.down[start]):
            if end - start >= 3:
                yield end, math.log10(26) + math.log10(end - start), "sequence"
        if (end := self.walks[start]) - start >= 3:
            turns = self.turns[end - 1] - self.turns[start + 1]
            yield end, math.log10(47 * (end - start)) + 0.3 * turns, "walk"


def guess_cost(value: str, ranks: Mapping[str, int] = RANK) -> tuple[float, list[tuple[str, str]]]:
    """log10 of the fewest guesses over all segmentations, and the best segmentation.

    Time is linear in the value's length: runs are taken whole, and a brute-force part
    grows by one sign at a time.
    """
    n, found = len(value), Parts(value, ranks)
    best = [math.inf] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    best[0] = 0.0
    brute = math.inf  # the cheapest way to here whose last part is brute force
    brute_start = 0
    for at in range(n):
        extra = PART_COST if at else 0.0
        # parts of every kind that begin here
        for end, cost, kind in found.at(at):
            if best[at] + cost + extra < best[end]:
                best[end], back[end] = best[at] + cost + extra, (at, kind)
        # a brute-force part goes on, or begins here
        sign = SIGN_COST[_kind(value[at])]
        if best[at] + extra < brute:
            brute, brute_start = best[at] + extra, at
        brute += sign
        if brute < best[at + 1]:
            best[at + 1], back[at + 1] = brute, (brute_start, "brute")
    parts, at = [], n
    while at > 0:
        start, kind = back[at]
        parts.append((kind, value[start:at]))
        at = start
    return best[n], parts[::-1]


@dataclass(frozen=True)
class ScanOptions:
    """A credential-context value counts from ``least_signs`` signs and ``least_guesses`` (log10) on."""

    least_signs: int = 6
    least_guesses: float = 9.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the format, end) of the fixed formats; failing matches use up their text."""
    found = []
    for number, (_, pattern, group, least) in enumerate(FORMATS):
        if number == 2:  # a run of hex digits is maximal, so shorter ones can be passed over
            pattern = HEX_RUN
        found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def guessed_spans(text: str, options: ScanOptions, ranks: Mapping[str, int] = RANK) -> list[tuple[int, int, int]]:
    """Values in credential contexts that need many guesses, as format number 3."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".,;:)]}>")
        if len(value) >= options.least_signs and guess_cost(value, ranks)[0] >= options.least_guesses:
            out.append((m.start(1), 3, m.start(1) + len(value)))
    return out


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how many rows of ``docs`` hold each word outside credential values.

    Tasks add up their own counts first.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in source:
            texts = pc.fill_null(batch.column(0), "")
            near = pc.match_substring_regex(texts, CONTEXT_HINT).to_pylist()
            for whole, has_context in zip(texts, near):
                plain = whole.as_py()
                if has_context:
                    plain = CONTEXT.sub(lambda m: m.group()[: m.start(1) - m.start()], plain)
                held = set(LETTERS.findall(plain.lower()))
                counts.update(w for w in held if LEAST_LETTERS <= len(w) <= MOST_LETTERS)
                if len(counts) >= HELD_WORDS:
                    yield passed_on()
                    counts.clear()
        yield passed_on()

    return docs.select(text).mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_ranks(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Rank of the fixed words and of the words that most documents hold, at most ``MOST_WORDS``."""
    work = Workspace(docs.sparkSession, "words")
    counted = work.save(document_counts(docs, text).where(F.col("n") >= LEAST_DOCS), "counts")
    # the lowest count that few enough words reach, from the words of each step of counts
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = sorted(((r["step"], r["words"]) for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    lowest, total = None, 0
    for at, words in steps:
        if (total := total + words) > MOST_WORDS:
            break
        lowest = at
    kept = [] if lowest is None else [(-r["n"], r["word"]) for r in counted.where(step >= lowest).collect()]
    work.drop("counts")
    ranks = {w: i for i, (_, w) in enumerate(sorted(kept), 1)}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in RANK.items()}


KINDS = ("assign", "access", "hex", "guess")
NO_SPANS = hashlib.sha256(b"").hexdigest()


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Counts by format, a digest of the fixed formats' spans, and all spans, for every row.

    A fast search on whole columns finds the texts that can hold anything; only those are
    then read by the exact patterns. Both see whole texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = pc.fill_null(batch.column(1), "")
            hit = pc.match_substring_regex(texts, CONTEXT_HINT)
            for hint in HINTS:
                hit = pc.or_(hit, pc.match_substring_regex(texts, hint))
            n = len(texts)
            counts = [[0] * n for _ in range(3)]
            digests, said = [NO_SPANS] * n, [""] * n
            for i in pc.indices_nonzero(hit).to_pylist():
                whole = texts[i].as_py()
                base = base_spans(whole)
                for _, k, _ in base:
                    counts[k][i] += 1
                digests[i] = hashlib.sha256(_said(base).encode()).hexdigest()
                said[i] = _said(sorted(base + guessed_spans(whole, options, sent.value)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(said, pa.string())],
                names=[id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(id_column, text).mapInArrow(batches, schema)

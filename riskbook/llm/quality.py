"""Text measures, and quality cutoffs that reject few good documents for certain.

Each rule turns away documents whose measure is above (or below) a cutoff. Cutoffs come from
a labelled holdout: for every stratum (language) and rule, the cutoffs of a fixed ladder are
tested from the mildest to the strictest, and the ladder is climbed only as long as the exact
(Clopper-Pearson) upper bound of the share of good documents turned away stays within the
rule's part of the allowed risk. Climbing in a fixed order needs no correction for the steps;
the error level is divided by the number of strata and rules. Of the certified cutoffs the
strictest is used at which low-quality documents are at least half of the labelled ones
turned away. A stratum with too few labels certifies nothing, and so turns nothing away.

Defined cases: a null or empty text has no words and fails the base rule; a null language is
a stratum of its own; a document whose language has no cutoffs is judged by the base rule
alone; repeated rows are measured each; labels of unknown documents are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import SPACE, mix, text_slices, windows
from .workspace import Workspace

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def slice_measures(part) -> dict[str, np.ndarray]:
    """The measures of every row of a slice."""
    data, words, lines = part.data, part.words(), part.lines()
    space = SPACE[data]
    hashes, rows = words.hashes(data), words.rows()

    n = len(hashes)
    wide = windows(hashes, WINDOW)
    inside = np.flatnonzero(np.arange(len(wide)) + WINDOW <= words.bounds[1:][rows[: len(wide)]])
    key = mix(wide[inside] + rows[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = inside[pd.Series(key).duplicated(keep=False).to_numpy()]
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0

    line_key = mix(lines.hashes(data) + lines.rows().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    solid = np.append(0, np.cumsum(~space))
    with_word = solid[lines.ends] > solid[lines.starts]
    repeated = pd.Series(line_key).duplicated(keep="first").to_numpy() & with_word
    return {
        "n_words": words.counts,
        "word_chars": _per_row(~space & ((data & 0xC0) != 0x80), part.offsets),
        "n_symbols": _per_row(SYMBOLS[data], part.offsets),
        "n_dup_lines": _per_row(repeated, lines.bounds),
        "n_repeat_words": _per_row(covered, words.bounds),
    }


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the five measures of every row; map-side, whole texts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch.column(len(keep))):
                found = slice_measures(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i)[part.rows] for i in range(len(keep))]
                    + [pa.array(found[m].astype(np.int64)) for m in MEASURES],
                    names=[*keep, *MEASURES],
                )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, text).mapInArrow(batches, ", ".join(kinds + [f"{m} long" for m in MEASURES]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Turns away documents whose ``value`` is above each ``ladder`` cutoff (mildest first)."""

    name: str
    value: str
    ladder: tuple[float, ...]


def _ladder(start: float, stop: float, steps: int) -> tuple[float, ...]:
    return tuple(round(start * (stop / start) ** (i / (steps - 1)), 6) for i in range(steps))


#: Measures relative to the text's size; every one is high in bad texts.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", _ladder(0.6, 0.03, 14)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _ladder(0.3, 0.03, 10)),
    Rule("lines", "n_dup_lines / greatest(n_words, 1)", _ladder(0.1, 0.005, 10)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", _ladder(40.0, 8.0, 10)),
    Rule("short_text", "1 / greatest(n_words, 1)", _ladder(1 / 21, 1 / 60, 8)),
)


@dataclass(frozen=True)
class Risk:
    """Allowed share of good documents turned away in a stratum, and the error level."""

    share: float = 0.04
    level: float = 0.05
    rules: tuple[Rule, ...] = field(default=RULES)
    #: Strata with fewer good labels can't certify any cutoff and are not fetched.
    least_labels: int = 100


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) of X ~ Binomial(n, p), summed from its largest terms."""
    if p <= 0:
        return 0.0
    if p >= 1:
        return 0.0 if k >= n else -math.inf
    terms = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def certified(k: int, n: int, share: float, level: float) -> bool:
    """Whether the exact upper bound at ``level`` for k of n is within ``share``.

    The bound is the p at which seeing k or fewer has probability ``level``, so it is
    within the share just if that probability at the share is not above the level.
    """
    if n <= 0 or k >= share * n:
        return False
    return log_binomial_tail(k, n, share) <= math.log(level)


def choose_cutoffs(counts: dict[tuple[str, int], tuple[int, int]], good: int, strata: int, risk: Risk) -> list[float | None]:
    """For one stratum, each rule's cutoff or None.

    ``counts[rule, step]`` holds the good and the bad documents that the step turns away.
    """
    level = risk.level / (strata * len(risk.rules))
    share = risk.share / len(risk.rules)
    out: list[float | None] = []
    for rule in risk.rules:
        best = None
        for step, cutoff in enumerate(rule.ladder):
            wrong, right = counts[rule.name, step]
            if not certified(wrong, good, share, level):
                break
            if right and right >= wrong:
                best = cutoff
        out.append(best)
    return out


def fit_cutoffs(labelled: DataFrame, risk: Risk = Risk(), stratum: str = "lang", label: str = "quality") -> list[tuple]:
    """(stratum, cutoff of each rule) from measured rows with a 0/1 label (null: not used).

    One aggregate with a row for each stratum; strata below ``least_labels`` stay behind, so
    what comes to the driver is at most one row for each hundred labels.
    """
    good, bad = F.col(label) == 1, F.col(label) == 0
    passes = labelled.where(~base_failed())
    columns = [F.count(F.when(good, 1)).alias("good"), F.count(F.when(bad, 1)).alias("bad")]
    for rule in risk.rules:
        for step, cutoff in enumerate(rule.ladder):
            hit = F.expr(rule.value) > cutoff
            columns.append(F.count(F.when(good & hit, 1)).alias(f"{rule.name}_{step}_good"))
            columns.append(F.count(F.when(bad & hit, 1)).alias(f"{rule.name}_{step}_bad"))
    rows = passes.groupBy(F.col(stratum).alias("stratum")).agg(*columns).where(F.col("good") >= risk.least_labels).collect()
    fitted = []
    for row in rows:
        counts = {
            (rule.name, step): (row[f"{rule.name}_{step}_good"], row[f"{rule.name}_{step}_bad"])
            for rule in risk.rules
            for step in range(len(rule.ladder))
        }
        fitted.append((row["stratum"], choose_cutoffs(counts, row["good"], len(rows), risk)))
    return fitted


def verdict(fitted: list[tuple], risk: Risk = Risk(), stratum: str = "lang") -> Column:
    """Whether a measured row passes the base rule and its stratum's cutoffs."""
    fails = F.lit(False)
    for value, cutoffs in fitted:
        hits = [F.expr(r.value) > c for r, c in zip(risk.rules, cutoffs) if c is not None]
        for hit in hits:
            fails = fails | (F.col(stratum).eqNullSafe(F.lit(value)) & hit)
    return ~base_failed() & ~fails


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document."""
    work = Workspace(docs.sparkSession, "quality")
    measured = work.save(measure(docs, ["doc_id", "lang"]), "measures")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    fitted = fit_cutoffs(measured.join(marks, "doc_id"), risk)
    return measured.select("doc_id", *MEASURES, base_failed().alias("base_failed"), verdict(fitted, risk).alias("kept"))

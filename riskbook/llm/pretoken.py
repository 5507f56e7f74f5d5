"""The usual byte-level pre-tokenizer as array operations, and its distinct pieces.

The pattern cuts a text into contractions, runs of letters, of digits and of other signs,
each with one space before it at most, and runs of white space. Since all of it hangs on
character classes of neighbours, the cuts of a whole slice are found at once.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import regex

from .textbuf import _random, span_hashes

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: After an apostrophe, the letters that make a contraction of their own (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    index = np.array(points)
    table = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, text):
            table[index[run.start() : run.end()]] = kind
    return table


@functools.cache
def _codes() -> np.ndarray:
    return _random(0x110000, 3)


class Pieces:
    """Pieces of many texts: ``starts``, ``ends`` in ``points``; text i owns ``bounds[i]:[i+1]``."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.points = p = np.frombuffer(self.text.encode("utf-32-le"), dtype=np.uint32)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        n = len(p)
        kind = _classes()[p]
        edge = np.zeros(n + 1, dtype=bool)  # a text starts here, or all end
        edge[offsets] = True
        cut = edge.copy()
        cut[1:n] |= kind[1:] != kind[:-1]  # runs of one class
        run_starts = np.flatnonzero(cut[:n])
        run_ends = np.append(run_starts[1:], n)
        start = cut
        blank = kind[run_starts] == BLANK if n else np.zeros(0, dtype=bool)
        # the last blank before something else stands alone, or goes with it if it is a space
        before = blank & ~edge[run_ends]
        start[run_ends[before] - 1] = True
        joined = run_ends[before]
        joined = joined[p[joined - 1] == 0x20]
        start[joined] = False
        # contractions: a lone apostrophe that no space is joined to
        quote = (p[run_starts] == 0x27) & (run_ends - run_starts == 1) & start[run_starts] & ~edge[run_ends]
        at = run_starts[quote]
        if len(at):
            padded = np.append(p, [0, 0, 0]).astype(np.uint32)
            gone = np.concatenate([edge, [True, True]])
            for letters in CONTRACTIONS:
                hit = np.ones(len(at), dtype=bool)
                for i, c in enumerate(letters, 1):
                    hit &= (padded[at + i] == ord(c)) & ~gone[at + i]
                found = at[hit]
                start[found + 1] = False
                start[found + 1 + len(letters)] = True
        start[n] = False
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each piece's distinct form, the forms' hashes, and where each is first seen."""
        hashes = span_hashes(_codes()[self.points], self.starts, self.ends)
        numbers, forms = pd.factorize(hashes)
        first = np.empty(len(forms), dtype=np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        return numbers, forms, first

    def form(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

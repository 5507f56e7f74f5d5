import math
import random
import re
from collections import Counter

import pytest

from riskbook.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, before, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in before
        before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "\n\n", "a", "a\na\na \n\n", "é中 ß|<>", "x y z " * 20, "w " * 100_000]
    for _ in range(60):
        out.append("".join(rng.choice(["a ", "b ", "é ", "\n", "#", "c\x0b", "a b c d e f g h "]) for _ in range(rng.randint(0, 60))))
    return out


def test_measures(frame):
    rows = [(i, "en", t, 5) for i, t in enumerate(texts())] + [(3, None, "again", 5)] * 2
    docs = frame(rows, "doc_id long, lang string, text string, n_words int")
    found = q.measure(docs, ["doc_id", "lang"]).collect()
    assert len(found) == len(rows)
    want = Counter((i, *brute(t)) for i, _, t, _ in rows)
    assert Counter((r["doc_id"], *[r[m] for m in q.MEASURES]) for r in found) == want


@pytest.mark.parametrize("n, share, level", [(50, 0.05, 0.05), (400, 0.01, 0.001), (3000, 0.008, 0.01)])
def test_certified_is_the_exact_bound(n, share, level):
    def tail(k):
        return sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))

    for k in range(0, int(share * n) + 2):
        assert q.certified(k, n, share, level) == (k < share * n and tail(k) <= level)
    assert not q.certified(0, 0, share, level)


def test_cutoffs_climb_only_while_certified():
    risk = q.Risk(share=0.1, level=0.05, rules=(q.Rule("r", "n_words", (9.0, 8.0, 7.0, 6.0)),))
    counts = {("r", 0): (0, 5), ("r", 1): (3, 20), ("r", 2): (95, 99), ("r", 3): (0, 90)}
    assert q.choose_cutoffs(counts, 1000, 1, risk) == [8.0]
    assert q.choose_cutoffs({k: (0, 0) for k in counts}, 1000, 1, risk) == [None]
    assert q.choose_cutoffs(counts, 10, 1, risk) == [None]


def good(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_junk_goes_and_good_texts_stay(frame):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(1600):
        bad = i % 4 == 0
        text = good(rng, rng.randint(40, 80))
        rows.append((i, "en" if i % 2 else None, text.replace(" ", "### ") if bad else text))
        marks.append((i, 0 if bad else 1) if i < 1400 else (i, None))
    rows += [(5000, "fr", good(rng, 50).replace(" ", "### ")), (5001, "en", None), (5002, "en", "too short")]
    docs = frame(rows, "doc_id long, lang string, text string")
    labels = frame(marks + [(9999, 1), (0, 0)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in q.judge(docs, labels, q.Risk(share=0.1)).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["kept"] == (i % 4 != 0) for i in range(1600))
    assert found[5000]["kept"] and not found[5001]["kept"] and found[5002]["base_failed"]


def test_without_labels_the_base_rule_decides(frame):
    rng = random.Random(3)
    docs = frame([(1, "en", good(rng, 30)), (2, "en", "a b " * 40), (3, "en", "#### " * 25)], "doc_id long, lang string, text string")
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in q.judge(docs, frame([], "doc_id long, quality int")).collect()}
    assert found == {1: (False, True), 2: (True, False), 3: (True, False)}
    assert q.judge(docs.limit(0), frame([], "doc_id long, quality int")).collect() == []

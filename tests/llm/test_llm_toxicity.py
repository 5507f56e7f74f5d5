import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskbook.llm import toxicity as t
from riskbook.llm.textbuf import text_slices

INSULTS = ["idiot", "moron", "scumbag", "worthless"]


def clean(rng, n):
    syllables = ["an", "the", "tion", "er", "ing", "lo", "ma", "ri", "su", "pe", "ka", "do"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def corpus(n, seed):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        words = clean(rng, rng.randint(10, 80)).split(" ")
        toxic = i % 3 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    return texts, marks


@pytest.fixture(scope="module")
def machine():
    return t.fit(*corpus(1500, 1))


def scores(machine, texts):
    kernel = t.Kernel(machine.landmarks)
    return np.concatenate([machine.scores(machine.margins(p, kernel)) for p in text_slices(pa.array(texts, pa.string()))])


def test_held_out_accuracy(machine):
    texts, marks = corpus(600, 2)
    right = (scores(machine, texts) >= 0.5) == np.array(marks, dtype=bool)
    assert right.mean() > 0.95


def test_gaps_and_inserted_characters(machine):
    base = "an lomating suer"
    plain, *varied = scores(machine, [f"{base} {w} dori" for w in ("mating", "idiot", "i d i o t", "i.d.i.o.t", "id1ot", "IDIOT", "idixot")])
    assert min(varied) > plain and min(varied[:5]) > 0.5


def test_kernel_is_the_sum_over_common_triples():
    def triples(word):
        signs = [t.START, *[ord(c) - 97 for c in word], t.END]
        out = {}
        for a in range(len(signs)):
            for b in range(a + 1, len(signs)):
                for c in range(b + 1, min(len(signs), a + t.SPAN)):
                    key = (signs[a], signs[b], signs[c])
                    out[key] = out.get(key, 0) + t.DECAY ** (c - a + 1)
        n = len(signs)
        if n > t.LONG:
            return out, sum(v * v for v in out.values()) ** 0.5
        squares = [t.DECAY ** (2 * (c - a + 1)) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, min(n, a + t.SPAN))]
        return out, sum(squares) ** 0.5

    code = lambda w: bytes([t.START, *[ord(c) - 97 for c in w], t.END])
    words, marks = ["idiot", "editor", "aaaa", "xyz", "idixot", "idiotmoron" * 60, "a"], ["idiot", "moron", "moron" * 70]
    got = t.Kernel([code(m) for m in marks]).dense(t.Words.of([code(w) for w in words]))
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            (a, na), (b, nb) = triples(w), triples(m)
            want = min(1.0, sum(v * b.get(k, 0) for k, v in a.items()) / na / nb) ** t.POWER
            assert got[i, j] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_whole_texts_count(machine):
    rng = random.Random(4)
    long = clean(rng, 40_000)
    a, b = scores(machine, [long, long + ". an idiot moron er worthless scumbag"])
    assert b > 0.5 and b > a


def test_hard_rows(frame, machine):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "12 34 ..."), (4, "12 34 ..."), (None, "an idiot moron"), (6, "é中 ß")]
    docs = frame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    found = docs.select("doc_id", t.held_out().alias("held_out"), t.score_text(machine).alias("score")).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    assert max(r["score"] for r in found if r["doc_id"] in (1, 2, 3, 4)) < 0.5
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_training_takes_no_held_out_rows_and_is_bounded(frame):
    texts, marks = corpus(200, 5)
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    labels = frame([*enumerate(marks), (0, None), (999, 1)], "doc_id long, toxic int")
    rows = t.training_rows(docs, labels, t.Options(most_rows=60)).collect()
    assert len(rows) == 60 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert sum(r["toxic"] for r in rows) == 30


def test_without_both_labels(frame):
    docs = frame([(1, "a b"), (2, None)], "doc_id long, text string")
    for marks, want in (([], 0.0), ([(1, 1), (2, 1), (6, 1)], 1.0)):
        machine = t.train(docs, frame(marks, "doc_id long, toxic int"))
        assert [round(r[0]) for r in docs.select(t.score_text(machine)).collect()] == [want, want]


def test_a_long_word_is_not_like_its_own_beginning():
    rng = random.Random(7)
    word = bytes([t.START, *[rng.randrange(26) for _ in range(2000)], t.END])
    part = word[:700] + bytes([t.END])
    (near,) = t.Kernel([part]).dense(t.Words.of([word]))[0]
    assert 0.1 < near < 0.6


def test_an_id_with_many_rows_brings_one_text(frame):
    docs = frame([(1, f"text {i}") for i in range(3000)] + [(2, None), (2, "b"), (4, "c"), (None, "d")], "doc_id long, text string")
    labels = frame([(1, 1), (1, 0), (2, 0), (4, None)], "doc_id long, toxic int")
    rows = t.training_rows(docs, labels, t.Options()).collect()
    ids = [r["doc_id"] for r in rows]
    assert sorted(ids) == sorted({i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5})
    assert all(r["toxic"] == (1 if r["doc_id"] == 1 else 0) for r in rows)
    assert rows == t.training_rows(docs.repartition(7), labels, t.Options()).collect()


def test_dropping_agrees_with_the_scores(machine, frame):
    texts = ["you idiot moron. worthless scumbag", "an lomating suer", None, "", "you idiot moron. worthless scumbag"]
    docs = frame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, _toxic_score string")
    left = t.drop_toxic(docs, machine)
    assert left.columns == docs.columns
    scored = docs.select("doc_id", t.score_text(machine).alias("p")).collect()
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in scored if r["p"] < 0.5)
    assert 0 < left.count() < len(texts)

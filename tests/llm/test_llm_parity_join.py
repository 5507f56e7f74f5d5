import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskbook.llm import parity_join as p
from riskbook.llm.textbuf import text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = WORD.findall((text or "").translate(LOW))
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """{(doc_id, n, component)} by comparing all pairs."""
    sets = [(d, grams(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (di, a) in enumerate(sets):
        for j, (dj, b) in enumerate(sets[:i]):
            if a and b and (100 * len(a & b) >= 75 * len(a | b) or (di is not None and di == dj)):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, a) in enumerate(sets):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(a), best.get(find(i)) if a else d) for i, (d, a) in enumerate(sets)), key=str)


def joined(frame, rows, link=p.Link()):
    docs = frame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    found = p.similar_components(docs, link).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str)


def edited(words, share, rng):
    return [f"w{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for base in range(6):
        words = [f"b{rng.randrange(10**6)}" for _ in range(rng.choice([6, 12, 40, 150, 700]))]
        for _ in range(25):
            rows.append(" ".join(edited(words, rng.choice([0, 0.005, 0.02, 0.04, 0.06, 0.1]), rng)))
        rows.append(" ".join(words[: max(1, int(len(words) * 0.8))]))
    rows += [" ".join([*passage, *[f"u{rng.randrange(10**9)}" for _ in range(30)]]) for _ in range(40)]
    rows += [" ".join(f"s{rng.randrange(3)}" for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("link", [p.Link(), p.Link(common=0.02, block=16)])
def test_components_are_those_of_all_pairs(frame, link):
    rows = corpus(4)
    assert joined(frame, rows, link) == brute(rows)


def test_defined_cases(frame):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"x{i}" for i in range(30))
    rows = [
        (7, None), (8, ""), (9, " \t\n"), (5, text), (3, text.upper().replace(" ", "\n ")), (5, text), (None, text), (None, None),
        (1, "one two"), (2, "ONE  two"), (4, "one"), (11, other), (11, "y z"), (12, other + " more"), (20, "long " * 100_000),
        (21, " ".join(str(i) for i in range(30_000))), (22, " ".join(str(i) for i in range(29_000))),
    ]
    assert joined(frame, rows) == brute(rows)


def test_empty_table(frame):
    assert joined(frame, []) == []


def test_one_stays_of_each_group(frame):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (7, None, "c"), (8, "", "d"), (9, "alone", "e"), (None, "x y", "f")]
    kept = p.keep_one(frame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in kept) == [("3", "b"), ("7", "c"), ("8", "d"), ("9", "e"), ("None", "f")]


def grams_of(texts, link):
    (part,) = list(text_slices(pa.array(texts), max_rows=1024))
    return p.Grams(part, link)


def test_bounds_hold_for_sketches_and_cells():
    rng, link = random.Random(2), p.Link()
    for _ in range(40):
        words = [f"b{rng.randrange(10**6)}" for _ in range(rng.choice([3, 5, 9, 30, 200, 900]))]
        texts = [" ".join(words), " ".join(edited(words, rng.choice([0.01, 0.03, 0.05]), rng))]
        g = grams_of(texts, link)
        a, b = (set(g.hashes[g.bounds[i] : g.bounds[i + 1]].tolist()) for i in (0, 1))
        bits = [np.frombuffer(x, np.uint64) for x in g.bits()]
        width = min(map(len, bits))
        assert np.bitwise_count(p.fold(bits[0], width) ^ p.fold(bits[1], width)).sum() <= len(a ^ b)
        if link.linked(len(a & b), len(a), len(b)):
            assert p.may_link(bits[0], len(a), bits[1], len(b), link)
            rows = np.array([0, 1])
            bands = p.band_of(g.sizes)
            up = link.largest_partner(g.sizes) >= p.band_top(bands)
            rows, bands = np.append(rows, rows[up]), np.append(bands, bands[up] + 1)
            row, token = g.cells(rows, bands, np.zeros(0, np.uint64), link)
            assert set(token[row == 0].tolist()) & set(token[row == 1].tolist())


def test_a_row_without_an_id_is_the_only_bridge(frame):
    words = [f"w{i}" for i in range(130)]
    a, b, c = (" ".join(words[i : i + 100]) for i in (0, 10, 20))
    link = p.Link()
    rows = [(1, a), (None, b), (3, c), (None, "other words that meet nothing at all in here")]
    found = {r["doc_id"]: r["component_id"] for r in p.similar_components(frame(rows, "doc_id long, text string"), link).where("doc_id is not null").collect()}
    assert found == {1: 1, 3: 1}
    alone = p.similar_components(frame([rows[0], rows[2]], "doc_id long, text string"), link).collect()
    assert {r["doc_id"]: r["component_id"] for r in alone} == {1: 1, 3: 3}


def test_blank_rows_of_an_id_leave_its_worded_row(frame):
    rows = [(1, ""), (1, "some words of a text"), (1, "some words of a text"), (1, None), (2, " "), (None, "x y z"), (None, "x y z")]
    kept = [tuple(r) for r in p.keep_one(frame(rows, "doc_id long, text string")).collect()]
    wanted = [(1, ""), (1, "some words of a text"), (1, None), (2, " "), (None, "x y z"), (None, "x y z")]
    assert sorted(kept, key=str) == sorted(wanted, key=str)


def test_keeping_one_leaves_a_column_of_its_own_name(frame):
    docs = frame([(1, "a b c", 5), (1, "a b c", 6), (2, "a b c", 7)], "doc_id long, text string, _same_id int")
    rows = p.keep_one(docs).collect()
    assert [(r["doc_id"], r["_same_id"] in (5, 6)) for r in rows] == [(1, True)]


def families(size, own):
    """Two families of near copies; across them the similarity is just below 0.75 with 67 own words, above with fewer."""
    core = [f"c{i}" for i in range(400)]
    return [" ".join([*core, *[f"{name}{i}" for i in range(own)], f"{name}end{k}"]) for name in "ab" for k in range(size)]


@pytest.mark.parametrize("own, components", [(67, 2), (60, 1)])
def test_families_below_the_threshold_report_no_list_of_pairs(spark, frame, own, components):
    rows = list(enumerate(families(700, own)))
    link = p.Link()
    (gram_sets,) = [[grams(t) for _, t in (rows[0], rows[700])]]
    assert (100 * len(gram_sets[0] & gram_sets[1]) >= 75 * len(gram_sets[0] | gram_sets[1])) == (components == 1)
    docs = frame(rows, "doc_id long, text string")
    nodes = p.describe(docs, link).where("gram is null").select("doc_id", "node", "n", "bits")
    members = nodes.selectExpr("1L as group", "node", "n", "case when doc_id < 700 then 0L else 1L end as piece")
    sets = p.sets_of(docs, nodes, link)
    assert p.block_pairs(members, nodes, link).count() <= 3  # at most one for each pair of blocks
    assert 0 <= p.block_pairs(members, sets, link, exact=True).count() <= 3 * (components == 1)
    found = {r["doc_id"]: r["component_id"] for r in p.similar_components(docs, link).collect()}
    assert set(found.values()) == ({0, 700} if components == 2 else {0})


def test_blocks_are_cut_by_their_n_grams_too(frame, monkeypatch):
    monkeypatch.setattr(p, "BLOCK_GRAMS", 3_000)
    monkeypatch.setattr(p, "CHUNK_BYTES", 10_000)
    rows = corpus(9)
    assert joined(frame, rows) == brute(rows)


def test_the_wide_sketch_folds_to_the_narrow_one():
    g = grams_of([" ".join(f"w{i}" for i in range(300))], p.Link())
    narrow = np.frombuffer(g.bits()[0], np.uint64)
    assert (p.fold(p.wide_bits(g.hashes), len(narrow)) == narrow).all()

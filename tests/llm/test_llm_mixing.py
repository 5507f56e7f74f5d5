import hashlib
import re
from collections import defaultdict

from riskbook.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights):
    """Targets by sharing the excess again and again."""
    total = sum(sizes.values())
    target = {s: 0.0 for s in sizes}
    full = set()
    while True:
        left = total - sum(3.0 * sizes[s] for s in full)
        open_weight = sum(weights[s] for s in sizes if s not in full)
        for s in sizes:
            target[s] = 3.0 * sizes[s] if s in full else left * weights[s] / open_weight
        above = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def brute(rows):
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    target = shared(sizes, weights)
    key = lambda i: (hashlib.md5(str(rows[i][0] if rows[i][0] is not None else "").encode()).hexdigest(), rows[i][0] or 0, size[i])
    copies = []
    for s in order:
        sent = 0
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=key):
            sent += size[i]
            if size[i] and target[s]:
                copies += [((e * sizes[s] + sent) / target[s], order.index(s), e, key(i), i) for e in range(3)]
    taken, sent = defaultdict(int), 0
    for *_, i in sorted(copies):
        sent += size[i]
        if sent <= sum(size):
            taken[i] += size[i]
    return sorted(((str(r[0]), size[i], sizes[r[2]], round(target[r[2]], 6), taken[i]) for i, r in enumerate(rows)))


def planned(frame, rows):
    found = mixing.plan_mix(frame([(*r, 9) for r in rows], "doc_id long, text string, source string, taken int")).collect()
    return sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found)


ROWS = [(i, "w " * (1 + i * 7 % 13), "abc"[i % 3] if i % 10 else "big") for i in range(400)]
ROWS += [(1000 + i, "v " * 5, "big") for i in range(300)]
ROWS += [(2000, "only these", "tiny"), (2001, None, "tiny"), (2002, "", None), (2003, " a\tb\x0bc ", None), (None, "no id", "é"), (2004, " \n", "blank")]


def test_plan(frame):
    assert planned(frame, ROWS) == brute(ROWS)


def test_sources_come_near_their_targets_and_reruns_agree(frame):
    found = planned(frame, ROWS)
    words, target = defaultdict(int), {}
    for _, size, source_size, goal, taken in found:
        words[source_size, goal] += taken
        target[source_size, goal] = goal
        assert taken <= 3 * size
    assert all(abs(words[k] - target[k]) <= 40 for k in words)
    assert abs(sum(words.values()) - sum(len(WORD.findall(t or "")) for _, t, _ in ROWS)) <= 13
    assert planned(frame, list(reversed(ROWS))) == found


def test_repeated_rows_and_ids(frame):
    rows = [(1, "a b c", "x")] * 4 + [(1, "d e", "x"), (2, "f", "y"), (2, "f", None)]
    found = planned(frame, rows)
    assert len(found) == 7 and sum(t for *_, t in found) <= 16
    mixed = mixing.mix(frame(rows, "doc_id long, text string, source string"))
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(t for *_, t in found)


def test_rows_come_as_often_as_they_are_taken(frame):
    docs = frame([(*r, "k") for r in ROWS], "doc_id long, text string, source string, copies string")
    plan = {(str(r["doc_id"]), r["size"]): r["copies"] for r in mixing.plan_mix(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[str(r["doc_id"]), len(WORD.findall(r["text"]))] += 1
    assert dict(seen) == {k: v for k, v in plan.items() if v}


def test_no_words_at_all(frame):
    assert planned(frame, []) == []
    assert planned(frame, [(1, None, "a"), (2, " ", None)]) == [("1", 0, 0, 0.0, 0), ("2", 0, 0, 0.0, 0)]


def test_columns_with_the_names_of_its_own(frame):
    docs = frame([(i, f"a b {i}", "s", 70 + i, "x") for i in range(3)], "doc_id long, text string, source string, _mix_place int, _mix_id string")
    rows = mixing.mix(docs).collect()
    assert {(r["doc_id"], r["_mix_place"], r["_mix_id"]) for r in rows} == {(i, 70 + i, "x") for i in range(3)}

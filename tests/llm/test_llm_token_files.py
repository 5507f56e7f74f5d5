import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskbook.llm import token_files as f

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*"abcdestrvml''  \n\t.,19é中🙂  !aaaa　", "'s", " '", "<|endoftext|>", "\r\n", "aaaaaaa", "    "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    rng = random.Random(7)
    texts = ["", " ", "\n", "<|endoftext|>a"] + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, bounds = f.LibraryEncoder(PATH).encode(texts)
    for text, coded, low, high in zip(texts, library.encode_batch(texts, add_special_tokens=False), bounds[:-1], bounds[1:]):
        assert coded.ids == ids[low:high].tolist(), text


@pytest.mark.parametrize("alphabet", [2, 5, 300, 50_000])
def test_shards_round_trip(alphabet):
    rng = np.random.default_rng(alphabet)
    lengths = rng.integers(0, 300, 80)
    ids = rng.integers(0, alphabet, lengths.sum()).astype(np.int32)
    bounds = np.append(0, np.cumsum(lengths))
    shard = f.Shard(f.write_shard(ids, bounds))
    assert (shard.expand(shard.symbols) == ids).all()
    for i in range(80):
        assert (shard.document(i) == ids[bounds[i] : bounds[i + 1]]).all()
    for _ in range(100):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.span(a, b) == ids[a:b]).all()


def test_frequent_pairs_become_rules():
    ids = np.tile([5, 6, 7, 8], 1000)
    shard = f.Shard(f.write_shard(ids, np.array([0, 2000, 4000])))
    assert len(shard.symbols) <= 40 and (shard.expand(shard.symbols) == ids).all()
    assert shard.lengths[f.VOCABULARY :].max() >= 64
    runs = np.full(999, 3)
    assert (f.Shard(f.write_shard(runs, np.array([0, 999]))).document(0) == runs).all()


def pairs_left(symbols, starts):
    """The most occurrences, none overlapping, that any pair of neighbours still has."""
    counts, last = {}, {}
    for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
        if i + 1 not in starts and not (a == b and last.get(a) == i - 1):
            counts[a, b] = counts.get((a, b), 0) + 1
            last[a] = i if a == b else None
    return max(counts.values(), default=0)


@pytest.mark.parametrize("alphabet", [1, 2, 40, 3000])
def test_no_pair_that_pays_is_left(alphabet):
    rng = np.random.default_rng(alphabet)
    lengths = rng.integers(0, 400, 60)
    ids = rng.integers(0, alphabet, lengths.sum())
    ids[ids % 3 == 0] = 0
    bounds = np.append(0, np.cumsum(lengths))
    symbols, rules, starts = f.compress(ids, bounds)
    assert pairs_left(symbols.tolist(), set(starts.tolist())) < f.LEAST_COUNT
    shard = f.Shard(f.write_shard(ids, bounds))
    assert (shard.expand(shard.symbols) == ids).all()
    assert len(shard.symbols) * 3 + len(rules) * 12 <= len(ids) * 3


def test_a_passage_in_many_documents_becomes_one_symbol():
    rng = np.random.default_rng(4)
    passage = rng.permutation(50_000)[:1000]
    docs = [np.concatenate([rng.integers(50_000, 60_000, 5), passage, [2]]) for _ in range(9)]
    bounds = np.append(0, np.cumsum([len(d) for d in docs]))
    shard = f.Shard(f.write_shard(np.concatenate(docs), bounds))
    assert shard.lengths.max() >= 1000 and len(shard.symbols) <= 9 * 7
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs))


def expected(rows, library):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_files(frame, library, tmp_path, shard_ids):
    rng = random.Random(9)
    rows = [(rng.randrange(10**6), "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [(-5, None), (7, ""), (7, ""), (7, "b"), (None, "x"), (None, None), (8, "word " * 60_000)]
    docs = frame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    files = f.write_tokens(docs, PATH, str(tmp_path / "files"), shard_ids=shard_ids)
    found = [tuple(r) for r in f.read_tokens(files).collect()]
    assert sorted(found, key=lambda r: r[1]) == expected(rows, library)


def test_empty_table(frame):
    assert f.round_trip(frame([], "doc_id long, text string"), PATH).collect() == []

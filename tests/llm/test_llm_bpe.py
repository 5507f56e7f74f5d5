import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskbook.llm import bpe
from riskbook.llm.pretoken import Pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*"abcdestrvml''  \n\t.,19é中🙂  !aaaa　", "'s", "'re", " '", "<|endoftext|>", "'ll", "\r\n", "aaaaaaa", "    "]
CASES = ["", " ", "\n", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a" * 999, "'s's don't 'S", "x  y   \n z", "\x00́é"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=3000):
    rng = random.Random(5)
    return CASES + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_and_text_are_the_librarys(library):
    many = texts()
    ids, bounds = bpe.Encoder(bpe.Vocabulary(PATH)).encode(many)
    for text, coded, low, high in zip(many, library.encode_batch(many, add_special_tokens=False), bounds[:-1], bounds[1:]):
        assert coded.ids == ids[low:high].tolist(), text
        again = library.decode(coded.ids, skip_special_tokens=False)
        assert bpe.vocabulary(PATH).decode(ids[low:high]).decode("utf-8", "replace") == again == text


def test_pieces_are_the_librarys(library):
    for text in texts(500):
        if "<|endoftext|>" in text:
            continue
        cut = Pieces([text])
        own = [cut.form(i) for i in range(len(cut.starts))]
        assert own == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    small, large = bpe.Encoder(bpe.vocabulary(PATH)), bpe.Encoder(bpe.vocabulary(PATH))
    many = texts(200)
    whole, _ = large.encode(many)
    parts = [i for t in many for i in small.encode([t])[0].tolist()]
    assert parts == whole.tolist()
    assert len(small.known) <= 60


def test_documents(frame, library):
    rows = [(1, "Hello there", 7), (2, None, 8), (2, None, 8), (None, "", 9), (4, "wörd " * 60_000, 1)]
    docs = frame(rows, "doc_id long, text string, n_tokens int")
    found = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode_documents(docs, PATH).collect()}
    assert bpe.encode_documents(docs, PATH).count() == 5
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = found[doc_id, len(ids)]
        assert row["ids"] == ids and row["decoded"] == (text or "")
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(frame):
    assert bpe.encode_documents(frame([], "doc_id long, text string"), PATH).collect() == []


def test_a_text_full_of_special_strings_is_walked_once():
    import time

    coder = bpe.encoder(PATH)
    spent = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        ids, ends = coder.encode(["a<|endoftext|>" * n, "b"])
        spent.append(time.perf_counter() - start)
        assert len(ids) == 2 * n + 1 and list(ends) == [0, 2 * n, 2 * n + 1] and (ids[1 : 2 * n : 2] == 50256).all()
    assert spent[1] < 10 * max(spent[0], 0.05)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} is not word{i * 7 % 31}, nor {i}\n" for i in range(40)]
    whole = [bpe.Encoder(bpe.vocabulary(PATH)).encode(texts[i : i + 4])[0].tolist() for i in range(0, 40, 4)]
    monkeypatch.setattr(bpe, "MEMORY", 30)
    coder = bpe.Encoder(bpe.vocabulary(PATH))
    assert [coder.encode(texts[i : i + 4])[0].tolist() for i in range(0, 40, 4)] == whole
    monkeypatch.undo()
    coder = bpe.Encoder(bpe.vocabulary(PATH))
    assert [coder.encode(texts[i : i + 4])[0].tolist() for i in range(0, 40, 4)] == whole
    assert (coder.known[1:] > coder.known[:-1]).all() and coder.encode([]) [0].size == 0

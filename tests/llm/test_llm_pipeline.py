import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskbook.llm import parity_join, toxicity
from riskbook.llm.components import connected_components
from riskbook.llm.registry import llm_oracles, llm_queries
from riskbook.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["idiot", "moron", "scumbag", "worthless"]


def tables(seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    syllables = ["an", "the", "tion", "er", "ing", "lo", "ma", "ri", "su", "pe", "ka", "do", "ve", "nu"]
    for i in range(500):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 60))]
        for _ in range(3 if i % 5 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(words) + ("\nAll rights reserved" if i % 3 == 0 else "")
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(i % 5 == 0)))
    twins = [(1000 + i, docs[3 * i + 1][1] + " tail", "en", "s9", 9) for i in range(40)]
    extra = [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2001, "", "en", "s1", 0), (2002, "All Rights reserved ", "en", "s0", 20)]
    return docs + twins + extra, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs, labels = tables()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def kept(spark, folder):
    """The rows that each stage returns."""
    work = Workspace(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, rows = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.save(stage(spark, docs, folder), name)
        rows[name] = docs.collect()
        assert name == "bpe" or docs.schema == schema
    return rows


def test_stages_against_what_they_should_do(kept):
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items()}

    toxic = {i for i in range(500) if i % 5 == 0}
    gone = {r[0] for r in tables()[0]} - set(ids["toxicity"])
    assert len(toxic & gone) > 95 and len(gone - toxic) < 15

    texts = {r["doc_id"]: r for r in kept["line_dedup"]}
    assert not any("rights" in (r["text"] or "").lower() for r in texts.values())
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values() if r["doc_id"] < 1000)
    assert sorted(map(str, ids["line_dedup"])) == sorted(map(str, ids["toxicity"]))

    left = set(ids["ngram_join"])
    assert len(ids["ngram_join"]) == len(left) + ids["ngram_join"].count(2001) - 1
    pairs = [(1000 + i, 3 * i + 1) for i in range(40) if 1000 + i in texts and 3 * i + 1 in texts]
    assert pairs and all(base in left and twin not in left for twin, base in pairs)
    assert {2000, 2001, 2002} <= left

    words = lambda r: len((r["text"] or "").split())
    total = sum(map(words, kept["ngram_join"]))
    assert 0.9 * total < sum(map(words, kept["mix"])) <= total
    assert max(map(ids["mix"].count, set(ids["mix"]))) <= 3

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_id = {r["doc_id"]: r["text"] for r in kept["mix"]}
    assert len(kept["bpe"]) == len(kept["mix"])
    assert all(r["ids"] == library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids for r in kept["bpe"])


def test_run_is_the_stages_in_a_row(spark, folder, kept):
    key = lambda rows: sorted((r["doc_id"], r["ids_sha256"]) for r in rows)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(kept["bpe"])
    assert len(kept["bpe"]) > 100


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registry():
    names = set(llm_queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(llm_oracles()) <= names


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    edges += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc"), "t").collect()
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert parity_join.Link().percent == 75 and toxicity.TOP == 3

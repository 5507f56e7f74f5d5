"""From documents to token ids in five stages, each written before the next one reads it.

1. toxicity: rows scored 0.5 or more go;
2. line dedup: lines of ten or more documents go, texts are joined again without them;
3. n-gram Jaccard join: of every group of near copies one row stays;
4. mixing: every row as many times as the mix of sources takes it;
5. byte-pair encoding: ids and digests of every row.

Stages 1 to 4 return the columns of documents; ``n_chars`` follows the text. A null text counts
as an empty one throughout and stays null where no stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.llm import bpe, line_dedup, mixing, parity_join, toxicity
from riskbook.llm.shipping import ship_package
from riskbook.llm.workspace import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the machine, trained on the labelled rows not held out, scores below 0.5."""
    ship_package(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, machine)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share."""
    kept = line_dedup.drop_common_lines(docs)
    changed = F.col("lines_dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *docs.columns
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of documents linked by five-word shingles at 0.75."""
    ship_package(spark)
    return parity_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, with digests of the ids and of the text decoded from them."""
    ship_package(spark)
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=outputs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL can't train the machine of the first stage; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs

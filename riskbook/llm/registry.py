"""The queries of this subpackage, by name, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship_package
from . import (
    ann, bpe, chat, line_dedup, mixing, parity_join, quality, secret_scan, sharding, token_files, toxicity,
    vector_codes, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts are control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    typed = turns.unionByName(extra).withColumn("parts", chat.text_parts())
    return chat.read_back(chat.format_turns(typed))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), outputs=outputs)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every vector whose id is divisible by twenty."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return parity_join.similar_components(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).drop("place", "copies")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether the certified rules keep it."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a machine that learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out().alias("held_out"), toxicity.score_text(machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from token files."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share, as digests."""
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("lines_before").alias("n_lines"),
        F.col("lines_dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight equal shards, and its shard among nine."""
    return sharding.plan_slots(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 8)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the eight leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every embedding, with exact errors."""
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_chat": op1_chat,
        "op2_bpe": op2_bpe,
        "op3_neighbours": op3_neighbours,
        "op4_secrets": op4_secrets,
        "op5_ngram_join": op5_ngram_join,
        "op6_mix": op6_mix,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_token_files": op9_token_files,
        "op10_lines": op10_lines,
        "op11_shards": op11_shards,
        "op12_whitening": op12_whitening,
        "op13_codes": op13_codes,
        "pipeline": corpus_pipeline.run,
    }


def llm_oracles() -> dict[str, str]:
    found = {
        "op1_chat": chat.SQL,
        "op3_neighbours": ann.SQL,
        "op5_ngram_join": parity_join.SQL,
        "op6_mix": mixing.SQL,
        "op10_lines": line_dedup.SQL,
        "op11_shards": sharding.SQL,
        "op13_codes": vector_codes.SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

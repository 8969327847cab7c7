"""The corpus queries by name, with production parameters over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, langid, lm, mixing, oracles, quality, repetition, sharding, tokens
from .shared import fold, read

SHARDS = [f"shard-{k:05d}" for k in range(sharding.N_SHARDS)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 5)
    out = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), part != 0, part == 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("key")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    model = langid.learn(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read(spark, sf_dir, "documents")).drop("key")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm.score(docs, fold(F.col("doc_id"), 7) == 2)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-7, k, r, r"\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.format_conversations(rows))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(repetition.coverage(read(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_quality, op3_mixing, op4_language_id, op5_jaccard_join, op6_lm_scoring, op7_chat, op8_token_counts, op9_repetition, op10_decontamination)}
#: The others learn a model or use a vocabulary; tests hold them against brute force or held-out rows.
ORACLES: dict[str, str] = {"op1_sharding": oracles.op1(sharding.lookup_table(SHARDS).tolist()), "op3_mixing": oracles.OP3, "op5_jaccard_join": oracles.OP5, "op7_chat": oracles.OP7, "op9_repetition": oracles.OP9, "op10_decontamination": oracles.OP10}

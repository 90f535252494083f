"""The ten operators as queries over their whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import chat, jaccard, langid, lm, mixing, ogg, pieces, rulefit, sharding, topk
from tributary.llm.text import held_out, table


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 5, 0)
    labelled = langid.sample(docs, ~held)
    return langid.predict(docs.select("doc_id", "text"), labelled).select("doc_id", held.alias("held_out"), "lang_pred", "score", "cost")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 10, 0)
    return lm.scores(docs, ~held).withColumn("held_out", held)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_rulefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 4, 2)
    model = rulefit.train(docs, table(spark, sf_dir, "labels"), ~held)
    return rulefit.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    added = added.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    return chat.digests(chat.conversations(turns.unionByName(added)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_pieces": op2_pieces,
    "op3_ogg": op3_ogg,
    "op4_langid": op4_langid,
    "op5_lm": op5_lm,
    "op6_sharding": op6_sharding,
    "op7_topk": op7_topk,
    "op8_rulefit": op8_rulefit,
    "op9_mixing": op9_mixing,
    "op10_chat": op10_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard": jaccard.ORACLE_SQL,
    "op6_sharding": sharding.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_chat": chat.ORACLE_SQL,
}

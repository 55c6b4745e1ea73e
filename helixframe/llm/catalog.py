"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, packing, pieces, pii, quality, shared, simhash, substring, token_store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return ann.search(table, table.where(F.col("vec_id") % 20 == 0))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.workspace(spark, "token-files")
    manifest = token_store.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(spark, folder, manifest).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(own)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.workspace(spark, "warc")
    index = warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.duplicate_passages(_table(spark, sf_dir, "documents")).drop("tag")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_cost_balanced_packing, op3_chat_format, op4_ann, op5_token_files, op6_quality_rules, op7_sentencepiece, op8_warc, op9_pii, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {"op3_chat_format": chat.ORACLE, "op8_warc": warc.ORACLE}

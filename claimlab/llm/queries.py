"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, quality, secrets, toxicity
from .chat_format import chat_digests, format_chats
from .common import table
from .decontaminate import contaminated
from .merkle import edit_fingerprints
from .mixing import mix
from .secrets import secret_digests
from .simhash_dedup import near_duplicates
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")))))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat_digests(format_chats(turns.unionByName(own)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op10_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_toxicity, op4_secret_scan, op5_chat_format, op6_token_files, op7_quality,
                                     op8_source_mix, op9_simhash_dedup, op10_merkle_fingerprint)}


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": secrets.SQL, "op5_chat_format": chat_format.SQL}

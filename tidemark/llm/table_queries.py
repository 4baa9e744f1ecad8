"""Queries that write, shard, scan, classify and search whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language import identify
from tidemark.llm.neighbours import nearest
from tidemark.llm.records import token_records
from tidemark.llm.registry import query, table
from tidemark.llm.secrets import scan, span_list
from tidemark.llm.sharding import shard_by_bytes

SHARDS = 40
END_ID = 2


@query("op1_token_records")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token records, read back from the files."""
    # 49,408 ids fit two bytes; the tokenizer lower-cases and takes classes of characters apart
    out = token_records(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID, by_class=True, width=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_histogram_sort")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    out = shard_by_bytes(table(spark, folder, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents: the base patterns, and entropy spans added to them."""
    found = scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(span_list("base").cast("binary"), 256).alias("base_sha256"), span_list("found").alias("spans"),
    )


@query("op6_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    return identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_neighbours")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, F.col("vec_id") % 50 == 0, 5)

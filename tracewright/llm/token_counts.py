"""Operator 6, token counts: a digest cache.

Counts are stored by two digests, of the normalised text and of the tokenizer's file. Documents meet the cache in a
join of digests; of the distinct texts it misses, one document each is encoded, and the new counts are appended.
White space is normalised for tokenizers that drop it, and nothing for others, so equal digests mean equal counts.
Texts of misses are shuffled once, spread evenly by doc_id whatever copies there are; copies, and what the cache has, are not encoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import P, shared_folder, ship, stored, text_of
from tracewright.llm.word_encoder import encoder, is_word_level, slices, version_of

DIGEST, NORMAL = f"{P}digest", f"{P}normal"
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def normalised(text: Column, word_level: bool) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if word_level else text


def encode_counts(misses: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) for rows of (DIGEST, NORMAL)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, NORMAL):
            n = [len(ids) // 4 for ids in encode(batch.column(NORMAL).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(DIGEST), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    ship(misses.sparkSession)
    return misses.select(DIGEST, NORMAL).mapInArrow(counted, "digest binary, n_tokens long")


def _held(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(DIGEST, n_tokens) that the cache has for this tokenizer; a cache that is not there yet is made."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return cache.where(F.col("version") == version).select(F.col("digest").alias(DIGEST), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, cache: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    `tokenizer` is a file that every executor has; `cache` a folder all of them share, kept from call to call (one writer
    at a time), or None for one that serves this call. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, ties and null doc_ids are
    counted each by its text. Only doc_id and text are read. An empty table gives an empty result.
    """
    spark, version, word_level = docs.sparkSession, version_of(tokenizer), is_word_level(tokenizer)
    path = cache or f"{shared_folder(spark)}/tracewright/token-counts-{uuid.uuid4().hex}"
    # the mark, a cheap hash of the text as it stands, tells texts of one doc_id apart; contents are normalised and digested once
    texts = docs.select("doc_id", text_of(docs).alias("text")).withColumn(f"{P}mark", F.xxhash64("text"))
    n_bytes = F.octet_length("text").cast("long")
    keys = stored(texts.select("doc_id", f"{P}mark", n_bytes.alias("n_bytes"), F.unhex(F.sha2(normalised(F.col("text"), word_level), 256)).alias(DIGEST)), "text-digests")
    # of each digest that the cache misses, one document; equal ones are merged where they are read
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc"), F.col(f"{P}mark").alias("mark"))
    distinct = keys.groupBy(DIGEST).agg(F.min(place).alias("one"))
    chosen = distinct.join(_held(spark, path, version), DIGEST, "left_anti").select(F.col("one.doc").alias(f"{P}doc"), F.col("one.mark").alias(f"{P}mark2"), DIGEST)
    misses = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col(f"{P}doc")) & (F.col(f"{P}mark") == F.col(f"{P}mark2")))
    encoded = encode_counts(misses.select(DIGEST, normalised(F.col("text"), word_level).alias(NORMAL)), tokenizer)
    fresh = encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a row that is repeated was encoded as often
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(path)

    wanted = keys.select(DIGEST).distinct()
    counts = stored(_held(spark, path, version).join(wanted, DIGEST, "left_semi").dropDuplicates([DIGEST]), "token-counts-met")
    return keys.join(counts.hint("merge"), DIGEST).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

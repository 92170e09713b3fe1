"""Operator 4, token counts: a digest cache keeps the library from meeting the same content twice.

Each text gets a digest of its content and one of its tokenizer's version. Counts that a cache table
already holds under both digests are joined; of the others, one text per digest is encoded, however many rows have it, and the
new counts are appended to the cache.

Defined cases: a null text counts as the empty one (0 bytes, 0 tokens); rows with a null doc_id are kept;
repeated rows each get a row, and are encoded once; texts of any length are read whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.chunk_encoder import ChunkEncoder
from muxlake.llm.common import documents, new_path, per_batch, saved

#: A content that at least this share of all rows have is heavy.
HEAVY_SHARE = 0.001
CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: its library and the digest of its file."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(version.encode() + b"\0" + f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty where none has been written."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _digested(docs: DataFrame) -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    return text, F.unhex(F.sha2(text, 256)).alias("content_digest")


def misses(docs: DataFrame, version: str, cache: str) -> DataFrame:
    """(content_digest, text) of the contents of docs(text) that the cache does not hold, one row each.

    Equal texts are reduced before the shuffle, so a task gets a content once from each task before it at most.
    """
    text, digest = _digested(docs)
    stored = read_cache(docs.sparkSession, cache).where(F.col("tokenizer_digest") == version).select("content_digest")
    each = docs.select(digest, text.alias("text")).groupBy("content_digest").agg(F.first("text").alias("text"))
    return each.join(stored, "content_digest", "left_anti")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs(doc_id, text); appends to the table at cache.

    The misses are written to the cache before the counts are joined, so a lost executor costs no encoded text. Digests that
    a HEAVY_SHARE of the rows have, 1 / HEAVY_SHARE of them at most, are joined by broadcast, the others by shuffle.
    """
    version = tokenizer_digest(tokenizer)
    text, digest = _digested(docs)
    rows = saved(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "digests")

    def count(batch: pa.RecordBatch):
        ids = ChunkEncoder.of(tokenizer).encode(batch.column("text").to_pylist())
        counts = pa.array([len(x) // 4 for x in ids], pa.int64())
        yield pa.record_batch([batch.column("content_digest"), counts], ["content_digest", "n_tokens"])

    new = per_batch(misses(docs, version, cache), count, "content_digest binary, n_tokens bigint")
    new.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(docs.sparkSession, cache).where(F.col("tokenizer_digest") == version)
    counts = known.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    least = max(2, math.ceil(rows.count() * HEAVY_SHARE))
    heavy = rows.groupBy("content_digest").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("content_digest")
    heavy = F.broadcast(saved(counts.join(F.broadcast(heavy), "content_digest"), "heavy"))
    light = rows.join(heavy, "content_digest", "left_anti").join(counts, "content_digest")
    return rows.join(heavy, "content_digest").unionByName(light).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all documents, with a cache that starts empty."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-counts"))

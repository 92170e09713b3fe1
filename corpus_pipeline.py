"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Defined cases, for every stage: null and empty texts pass or go by the stage's own rule and never fail it; texts are read whole, however long; rows that share a
doc_id, equal rows and ties each have a result of their own, but for near_duplicates, which keeps one of equal rows; an empty table gives an empty table; further columns
are carried along whatever their names are (where one is called n_tokens or token_ids, in any case, byte_bpe's own get another name).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm import op2_decontamination, op6_secret_scan, op7_ngram_join, op8_byte_bpe, op10_quality_rules
from muxlake.llm.common import cols, documents, fresh, new_path, remove, scratch, short_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the rules reject, null and empty texts among them, and takes lines that too many documents of a host share out of the others."""
    short_batches(spark)
    return op10_quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id (null: last) of each class of similar ones, and every text without words."""
    short_batches(spark)
    return op7_ngram_join.first_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole, cut or edited; texts without words hold none."""
    short_batches(spark)
    return op2_decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; a null text becomes an empty one."""
    return op6_secret_scan.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and token_ids of each text, and takes as text what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    taken = {c.lower() for c in docs.columns}
    n_tokens, ids = (name if name not in taken else fresh(docs, name)[0] for name in ("n_tokens", "token_ids"))
    own_ids, decoded = fresh(docs, "ids", "decoded")
    encoded = op8_byte_bpe.with_ids(docs, path, public_tokenizers.PATTERN, own_ids, decoded)
    text = [F.col(decoded).alias("text") if c == "text" else cols(c)[0] for c in docs.columns]
    return encoded.select(*text, F.size(own_ids).cast("long").alias(n_tokens), F.col(own_ids).alias(ids))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the alignment and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):  # what a stage writes on its way goes when its result is there, and so does what it read
            docs = written(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

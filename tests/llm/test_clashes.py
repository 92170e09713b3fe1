"""Columns of users that are called as the operators' own are carried along or ignored."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from muxlake.llm import op1_quality_crf, op3_token_files, op4_token_counts, op5_chat_collapse, op6_secret_scan, op7_ngram_join, op8_byte_bpe, op9_language_id, op10_quality_rules
from muxlake.llm import op2_decontamination as op2
from muxlake.llm.common import fresh, new_path, written

SMALL = "/root/testdata/sf0.001"
OWN = {"doc_id", "text", "lang", "source", "n_chars", "row"}


def internal_names():
    """Every quoted word of the operators' sources, and what fresh makes of it."""
    words = set()
    for path in Path(op2.__file__).parent.glob("*.py"):
        words |= set(re.findall(r"""["']([a-z_][a-z0-9_]*)["']""", path.read_text()))
    return sorted((words | {f"_{w}" for w in words}) - OWN - {f"_{w}" for w in OWN})


@pytest.fixture(scope="module")
def clashing(odd):
    names = internal_names()
    assert len(names) > 150
    return odd.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names))).cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_carry_clashing_columns(name, stage, clashing, odd, spark):
    out = stage(spark, clashing, SMALL)
    assert out.columns == clashing.columns
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
    assert key(out) == key(stage(spark, odd, SMALL))
    extra = clashing.columns[-1]
    assert {r[0] for r in out.select(f"`{extra}`").distinct().collect()} <= {len(internal_names()) - 1}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_carry_names_of_any_kind(name, stage, odd, spark):
    extra = {"Decoded": 1, "N_TOKENS": 2, "a.b": 3, "c`d": 4, "Token_Ids": 5, "_ids": 6, "Hash": 7}
    docs = odd.select("*", *(F.lit(v).alias(k) for k, v in extra.items()))
    out = written(stage(spark, docs, SMALL), new_path(spark, "odd-names"))
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert r.asDict().items() >= extra.items()
    if name == "byte_bpe":
        assert out.columns[len(docs.columns) :] == ["_n_tokens", "_token_ids"] and {len(r["_token_ids"]) - r["_n_tokens"] for r in out.collect()} == {0}


def test_byte_bpe_stage(clashing, odd, spark):
    out = corpus_pipeline.STAGES[-1][1](spark, clashing, SMALL)
    assert out.columns[: len(clashing.columns)] == clashing.columns and out.count() == odd.count()


def test_operators_ignore_clashing_columns(clashing, odd, spark):
    import public_tokenizers as public

    path = public.path("word_bpe_49k.json")
    labels = spark.createDataFrame([(2, 1), (5, 0), (8, 1)], "doc_id long, quality int").withColumn("id", F.lit(0)).withColumn("text", F.lit(""))
    n = odd.count()
    assert op1_quality_crf.score(clashing, op1_quality_crf.learn(clashing, labels)).count() == n
    folder = new_path(spark, "files")
    assert op3_token_files.read_token_files(op3_token_files.write_token_files(clashing, folder, path, end_id=2), folder).count() == n
    assert op4_token_counts.token_counts(clashing, path, new_path(spark, "cache")).count() == n
    assert op6_secret_scan.scan(clashing).count() == n
    assert op7_ngram_join.similarity_classes(clashing).count() == n
    assert op8_byte_bpe.encode_digests(clashing, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == n
    assert op9_language_id.identify(clashing, op9_language_id.learn(clashing)).count() == n
    assert op10_quality_rules.judged(clashing).count() == n
    chats = clashing.drop("conv_id", "turn", "role").select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "*")
    assert op5_chat_collapse.render(chats.drop("doc_id")).count() > 0


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id AS _id", "id AS _ID_1", "id AS x")
    assert fresh(df, "id", "x") == ["_id_2", "_x"]

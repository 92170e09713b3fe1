"""The pipeline against the brute-force versions of its stages."""

import public_tokenizers as public
import tiktoken
from test_op2 import brute as leaks
from test_op6 import spans
from test_op7 import brute as classes
from test_op10 import base, verdicts

import corpus_pipeline
from muxlake.llm import op8_byte_bpe

SMALL = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kind = docs.schema
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SMALL)
        rows = docs.collect()
        states[name] = (before, rows)
        if name != "byte_bpe":
            assert docs.columns == kind.names and all(len(r.text) == r.n_chars for r in rows)
            docs = spark.createDataFrame(rows, kind).repartition(3)
    before, rows = states["quality_rules"]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r, (_, kept) in zip(before, verdicts(before, 12)) if kept)
    assert all(not base(r.text)[5] for r in before if r.doc_id in {x.doc_id for x in rows})
    before, rows = states["near_duplicates"]
    first = {c for _, c, _ in classes([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in rows} == first and len(rows) == len(first)
    before, rows = states["decontamination"]
    bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in rows} == {r.doc_id for r in before} - bad
    before, rows = states["secret_scan"]
    assert len(rows) == len(before) and not any(spans(r.text) for r in rows)
    before, rows = states["byte_bpe"]
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=op8_byte_bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == texts[r.doc_id] and r.token_ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 50


def test_odd_rows_pass_all_stages(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).cache()
        assert docs.columns[: len(odd.columns)] == odd.columns

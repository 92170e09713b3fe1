"""Operators 3 and 4 against the tokenizer library on whole texts."""

import struct
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muxlake.llm import op3_token_files as op3
from muxlake.llm import op4_token_counts as op4
from muxlake.llm.chunk_encoder import ChunkEncoder
from muxlake.llm.common import new_path

PATH = public.path("word_bpe_49k.json")


def ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunks_give_the_ids_of_whole_texts():
    texts = [
        "I'll  go\n\n x\t　y  z\x1c\x1f!", "naïve Ωmega 12½ ٠١ don't\xa0stop¶", "¶ ¶¶ a¶b", "<|endoftext|>x<|startoftext|> <| endoftext|>",
        "á é ́alone ̈́", "ΑΣ ΣΑΣ İi", None, "", "x" * 5000 + " " + "é" * 300, "\U0001F600\U0001F600 end", "a\u0085b c",
    ]
    encoder = ChunkEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(texts)] == ids(texts)
    rest = ChunkEncoder(public.path("piece_bpe_32k.model"))
    assert not rest.by_chunk and len(rest.encode(["a b"])[0]) > 0


@pytest.mark.parametrize("table", ["small", "odd", "empty"])
def test_counts(table, request, spark):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    cache = new_path(spark, "cache")
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(x), len(x) > 2048) for r, x in zip(rows, ids([r.text for r in rows]))), key=str)
    for _ in range(2):
        got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op4.token_counts(docs, PATH, cache).collect()]
        assert sorted(got, key=str) == want
    stored = op4.read_cache(spark, cache)
    assert stored.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    if table == "odd":
        op4.token_counts(docs, public.path("piece_bpe_32k.model"), cache)
        assert op4.read_cache(spark, cache).select("tokenizer_digest").distinct().count() == 2


@pytest.mark.parametrize("table,size", [("small", 64 << 20), ("small", 50_000), ("odd", 64 << 20), ("empty", 64 << 20)])
def test_files(table, size, request, spark):
    docs = request.getfixturevalue(table)
    folder = new_path(spark, "files")
    manifest = op3.write_token_files(docs, folder, PATH, end_id=2, length=128, rows_per_batch=8, file_bytes=size)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r, x in zip(rows, ids([r.text for r in rows])):
        want.append((r.doc_id, start, len(x) + 1, zlib.crc32(struct.pack(f"<{len(x) + 1}I", *x, 2))))
        start += len(x) + 1
    got = [tuple(r) for r in op3.read_token_files(manifest, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if table == "small":
        local = folder.removeprefix("file://")
        name = manifest.orderBy("part", "number").first().file
        with pa.memory_map(f"{local}/{name}.arrow") as f:
            whole = op3.read_tokens(f)
            for k in (0, 9):
                tokens, mask = op3.sequence(f, k, 8)
                assert len(tokens) == 128 and tokens.dtype == np.uint16 and mask.true_count == 128
                assert (tokens == whole[k * 128 : k * 128 + 128]).all() and not tokens.flags.owndata


def test_one_id_over_many_files(spark):
    rows = [(5, f"{k} " + "several words of a text that is encoded " * (20 + k % 7)) for k in range(60)] + [(4, "before"), (6, "behind"), (7, None)]
    rows += [(None, "w " * 3000)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = new_path(spark, "files")
    manifest = op3.write_token_files(docs, folder, PATH, end_id=2, length=64, rows_per_batch=8, file_bytes=4000)
    assert manifest.where("first_doc = 5").count() > 6
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for (doc_id, _), x in zip(rows, ids([t for _, t in rows])):
        want.append((doc_id, start, len(x) + 1))
        start += len(x) + 1
    got = [(r.doc_id, r.start, r.n_tokens) for r in op3.read_token_files(manifest, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_rows_are_encoded_once(spark, monkeypatch):
    docs = spark.range(5000).select((F.col("id") % 3).alias("doc_id"), F.lit("the same row again and again").alias("text")).repartition(6)
    cache = new_path(spark, "cache")
    assert op4.misses(docs, op4.tokenizer_digest(PATH), cache).count() == 1
    rows = op4.token_counts(docs, PATH, cache).collect()
    assert len(rows) == 5000 and len({(r.n_bytes, r.n_tokens) for r in rows}) == 1
    assert op4.read_cache(spark, cache).count() == 1 and op4.misses(docs, op4.tokenizer_digest(PATH), cache).count() == 0

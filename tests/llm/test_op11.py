"""Operator 11: the chain against enumeration, evidence and sums against brute force, held-out accuracy, odd rows."""

import math
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from muxlake.llm import chain
from muxlake.llm import op11_toxicity as op


@pytest.mark.parametrize("same", [0.8, -1.5, 0.0])
def test_chain_is_the_sum_over_all_labellings(same):
    rng = np.random.default_rng(5)
    sizes = np.array([3, 0, 1, 6, 2])
    unary = rng.normal(size=sizes.sum()) * 3
    one, equal, norm = chain.forward_backward(unary, same, sizes)
    assert np.allclose(one, chain.forward_backward(unary, same, sizes, pairs=False)[0])
    at = 0
    for d, n in enumerate(sizes):
        ways = list(product((0, 1), repeat=int(n)))
        w = np.array([np.exp(np.dot(unary[at : at + n], y) + same * sum(a == b for a, b in zip(y, y[1:]))) for y in ways])
        assert np.isclose(norm[d], np.log(w.sum()))
        for t in range(n):
            assert np.isclose(one[at + t], sum(x for x, y in zip(w, ways) if y[t]) / w.sum())
            if t:
                assert np.isclose(equal[at + t], sum(x for x, y in zip(w, ways) if y[t] == y[t - 1]) / w.sum())
        at += n


def test_chain_in_blocks_is_the_chain_step_by_step():
    rng = np.random.default_rng(6)
    for sizes in (np.array([4000]), rng.integers(0, 40, 300), np.array([0, 0]), np.zeros(0, int)):
        u, same, at = rng.normal(size=sizes.sum()) * 5, 1.3, 0
        one, equal, norm = chain.forward_backward(u, same, sizes)
        for n, z in zip(sizes, norm):
            a = np.zeros((n, 2))
            for t in range(n):
                a[t, 0] = np.logaddexp(a[t - 1, 0] + same, a[t - 1, 1]) if t else 0
                a[t, 1] = (np.logaddexp(a[t - 1, 1] + same, a[t - 1, 0]) if t else 0) + u[at + t]
            assert np.isclose(z, np.logaddexp(*a[-1]) if n else 0)
            if n:
                assert np.isclose(one[at + n - 1], np.exp(a[-1, 1] - z))
            at += n


def test_evidence_is_counted_by_documents(spark):
    texts = [(k, int(k % 3 == 0), ("Vile vileness " if k % 3 == 0 else "plain ") * (1 + k % 4) + f"word{k} common") for k in range(90)]
    found = op.evidence(spark.createDataFrame(texts, "id long, toxic int, text string").repartition(7))
    docs = [(y, {k for w in t.lower().split() for k in op.keys(w)}) for _, y, t in texts]
    n = [sum(y == v for y, _ in docs) for v in (0, 1)]
    expected = {}
    tested = [w for w in set().union(*(d for _, d in docs)) if sum(w in d for y, d in docs if y) >= op.MIN_DOCS]
    for w in tested:
        b, a = (sum(w in d for y, d in docs if y == v) for v in (0, 1))
        p = n[1] / sum(n)
        ratio = 2 * sum(x * math.log(x / ((a + b) * q)) for x, q in ((a, p), (b, 1 - p)) if x)
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        if ratio >= op.MARGIN + 2 * math.log(len(tested)) and odds >= math.log(op.MIN_ODDS):
            expected[w] = min(odds, 6.0) / 3
    assert found.keys() == expected.keys() and "vile" in found and "common" not in found
    assert all(math.isclose(found[w], expected[w]) for w in found)


def test_sums_and_scores(spark):
    rng = np.random.default_rng(2)
    sizes = np.array([0, 3, 1, 0, 7])
    p = rng.random(11)
    sums = op.document_sums(p, sizes)
    at = 0
    for n, s in zip(sizes, sums):
        own = sorted(p[at : at + n], reverse=True) + [0, 0]
        assert np.allclose(s, [sum(own), own[0], own[1], sum(x >= 0.5 for x in own), n])
        at += n


def test_pieces_cut_no_word():
    text = "".join(np.random.default_rng(1).choice(list("ab  ,\n"), 5000))
    cut = list(op.pieces(text, 50))
    assert "".join(t for _, t in cut) == text and all(text[a : a + len(t)] == t for a, t in cut)
    assert [w for _, t in cut for w in op.WORD.findall(t)] == op.WORD.findall(text)
    assert list(op.pieces("x" * 200, 50)) == [(0, "x" * 200)]


@pytest.fixture(scope="module")
def tagger(spark):
    docs = op.documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return op.learn(docs, labels.where(op.fold_of("doc_id", 5) != 0))


def test_held_out_accuracy(spark, tagger):
    docs = op.documents(spark, "/root/testdata/sf0.01")
    rows = {r.doc_id: r for r in op.score(docs, tagger).collect()}
    assert len(rows) == 1000
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(r.toxic, rows[r.doc_id]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([t == r.predicted for t, r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_spans_are_words_of_the_text(spark, tagger):
    texts = ["What a worthless IDIOT, you moron!\nAll fine here. ", "a kind word for everyone", "", None]
    texts.append(("nothing here " * 100_000) + "a stupid clown " + "x" * 100)
    rows = op.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).orderBy("doc_id").collect()
    words = [[texts[r.doc_id][s.start : s.end] for s in r.spans] for r in rows]
    assert words[:4] == [["worthless IDIOT", "moron"], [], [], []] and words[4] in (["stupid clown"], ["stupid", "clown"])
    assert rows[0].predicted == 1 and rows[1].score < 0.3 and rows[2].score == rows[3].score < 0.3


@pytest.mark.parametrize("table", ["odd", "empty"])
@pytest.mark.parametrize("marks", [[(2, 1), (5, 0), (8, 1), (None, 1), (7, None)], [(2, 1)], []])
def test_odd_rows(table, marks, request, spark):
    docs = request.getfixturevalue(table).withColumn("id", F.lit(1)).withColumn("toxic", F.lit("x")).withColumn("sums", F.lit(0))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = op.score(docs, op.learn(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    if len(marks) < 2 and rows:
        assert {r.score for r in rows} == {1.0 if marks and table == "odd" else 0.0}

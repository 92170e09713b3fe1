"""Operator 1: the field against enumeration of all labellings, held-out accuracy, odd rows."""

from itertools import product

import numpy as np
import pytest

from muxlake.llm import op1_quality_crf as op


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 5, 2])
    unary, same = rng.normal(size=sizes.sum()), 0.8
    good, equal, norm = op.forward_backward(unary, same, sizes)
    at = 0
    for d, n in enumerate(sizes):
        u = unary[at : at + n]
        ways = list(product((0, 1), repeat=int(n)))
        w = np.array([np.exp(np.dot(u, y) + same * sum(a == b for a, b in zip(y, y[1:]))) for y in ways])
        assert np.isclose(norm[d], np.log(w.sum()))
        for t in range(n):
            assert np.isclose(good[at + t], sum(x for x, y in zip(w, ways) if y[t]) / w.sum())
            if t:
                assert np.isclose(equal[at + t], sum(x for x, y in zip(w, ways) if y[t] == y[t - 1]) / w.sum())
        at += n


def test_a_long_text_is_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    lines = ["A good line, with words.", "BAD ## bad !!", "", "   ", "short", "x" * 40]
    texts = ["\n".join(rng.choice(lines, n)) for n in (1, 7, 300, 3000)] + ["", None, "\n\n", "\nlast"]
    weights = rng.normal(size=3 * op.N_MEASURES)
    field = op.Field(rng.normal(size=len(weights)), np.abs(rng.normal(size=len(weights))) + 0.5, weights, 0.3, 0.7)
    x, sizes, length = op.measure(texts)
    good, _, _ = op.forward_backward((x - field.mean) / field.scale @ field.weights + field.bias, field.same, sizes)
    begin = np.cumsum(sizes) - sizes
    want = np.add.reduceat(good * length, begin) / np.add.reduceat(length, begin)
    assert np.allclose(field.scores(texts), want, atol=1e-5)
    monkeypatch.setattr(op, "PIECE", 50)
    monkeypatch.setattr(op, "CHUNK", 7)
    assert np.allclose(field.scores(texts), want, atol=1e-5)


def test_memory_of_a_text_of_short_lines():
    import tracemalloc

    weights = np.ones(3 * op.N_MEASURES) / 50
    field = op.Field(np.zeros(len(weights)), np.ones(len(weights)), weights, 0.0, 0.5)
    text = "ab c\n" * 1_000_000
    tracemalloc.start()
    assert 0 <= field.scores([text])[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 1000
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(r.quality, rows[r.doc_id]) for r in labels if rows[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([q == r.predicted for q, r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


@pytest.mark.parametrize("table", ["odd", "empty"])
@pytest.mark.parametrize("marks", [[(2, 1), (5, 0), (8, 1), (None, 1), (7, None)], [(2, 1)], []])
def test_odd_rows(table, marks, request, spark):
    docs = request.getfixturevalue(table)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    rows = op.score(docs, op.learn(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    if len(marks) == 1 and rows:
        assert {r.score for r in rows} == {1.0}


def test_sample_is_bounded(spark):
    rows = [(k % 4, f"text {k}\n" * (1 + k % 3)) for k in range(400)] + [(1, "a\n" * 500), (2, None), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)] + [(3, 1), (3, 0)], "doc_id long, quality int")
    every = op.sampled(docs, labels, 1000, 10_000).collect()
    known = {(i, q) for i, q in [(k, k % 2) for k in range(4)] + [(3, 0)]}
    assert len(every) == len({(i, q, t) for i, t in rows for a, q in known if a == i and (t or "").count("\n") < 100})
    assert len(op.sampled(docs, labels, 3, 10_000).collect()) == 3
    few = op.sampled(docs, labels, 1000, 600).collect()
    assert 0 < len(few) < len(every) and sum((r.text or "").count("\n") + 1 for r in few) <= 600

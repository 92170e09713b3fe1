"""Operator 9: Viterbi against all label sequences, held-out accuracy, mixed texts and odd rows."""

from itertools import product

import numpy as np
import pytest

from muxlake.llm import op9_language_id as op


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(7)
    sizes = np.array([4, 0, 1, 6, 3])
    scores, prior = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=3)
    got, at = op.viterbi(scores, sizes, prior, 0.7), 0
    for n in sizes:
        own = scores[at : at + n]
        total = lambda p: prior[p[0]] + sum(own[t, s] for t, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        if n:
            assert tuple(got[at : at + n]) == max(product(range(3), repeat=int(n)), key=total)
        at += n


def test_held_out_accuracy(spark):
    rows = op.query(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and len(held) > 200
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_falls_into_spans(spark):
    english = "the house and the garden were with that other thing " * 30
    russian = "это большой дом и зелёный сад который стоит там " * 30
    german = "und die Straße nicht der Garten mit einem schönen Haus " * 30
    train = spark.createDataFrame([(english, "en"), (russian, "ru"), (german, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = op.learn(train)
    assert model.languages == ("de", "en", "ru")
    text = "the house and the garden. это зелёный сад и дом, und der Garten nicht mit dem schönen Haus"
    row = op.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, switch=3.0).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "de"]
    assert [text[s.start : s.end] for s in row.spans][1] == "это зелёный сад и дом"


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(table, request, spark):
    docs = request.getfixturevalue(table)
    model = op.learn(docs)
    assert (model is None) == (table == "empty")
    rows = op.identify(docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])


def test_nothing_learned(spark, odd, empty):
    rows = op.identify(odd, op.learn(empty)).collect()
    assert {r.lang_pred for r in rows} == {"und"} and len(rows) == odd.count()


def test_many_languages(spark):
    names = [f"l{k:03d}" for k in range(300)]
    word = lambda k: "".join(chr(97 + (k * 7 + j * 5 + k // 26 * j) % 26) for j in range(9))
    train = spark.createDataFrame([(f"{word(k)} " * 20, x) for k, x in enumerate(names)], "text string, lang string")
    model = op.learn(train)
    rows = op.identify(spark.createDataFrame([(k, f"{word(k)} " * 6) for k in range(300)], "doc_id long, text string"), model).collect()
    same = {k: min(j for j in range(300) if word(j) == word(k)) for k in range(300)}
    assert {r.doc_id: r.lang_pred for r in rows} == {k: names[same[k]] for k in range(300)}


def test_buckets_are_shared_as_languages_grow(spark, monkeypatch):
    sizes = [op.n_buckets(n) for n in (1, 2, 128, 129, 500, 5000, op.CELLS // op.LEAST_BUCKETS)]
    assert sizes == [1 << 16, 1 << 16, 1 << 16, 1 << 15, 1 << 14, 1 << 10, 1 << 8]
    monkeypatch.setattr(op, "CELLS", 1 << 16)
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "quick brown foxes jump over", "cc": "zwei kleine katzen spielen dort"}
    extra = {f"x{k}": f"{chr(97 + k)}{chr(122 - k)}{chr(97 + k)}q" for k in range(20)}
    train = spark.createDataFrame([(f"{t} " * 30, x) for x, t in {**words, **extra}.items()], "text string, lang string")
    model = op.learn(train)
    assert len(model.scores) == op.n_buckets(23) == 1 << 11
    rows = op.identify(spark.createDataFrame([(k, f"{t} " * 4) for k, t in enumerate(words.values())], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == dict(enumerate(words))
    monkeypatch.setattr(op, "CELLS", op.LEAST_BUCKETS * 20)
    with pytest.raises(ValueError):
        op.learn(train)

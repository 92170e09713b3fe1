"""Operator 7 against all pairs of n-gram sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from muxlake.llm import op7_ngram_join as op
from muxlake.llm.shingles import ngram_hashes, word_hashes


def ngrams(text, n=5):
    w = [x.decode() for x in (text or "").lower().encode().split()]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [ngrams(t) for _, t in rows]
    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    common = {}
    for ks in where.values():
        for a in ks:
            for b in ks:
                if a < b:
                    common[a, b] = common.get((a, b), 0) + 1
    part, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while part[k] != k:
            k = part[k]
        return k

    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            part[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return sorted(((i, first.get(find(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def found(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in op.similarity_classes(docs).collect()), key=str)


@pytest.mark.parametrize("table", ["small", "odd", "empty"])
def test_tables(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_NODES", 15)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(120):
        own = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(100)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(own)))
    rows += [(500 + k, " ".join(f"o{k}y{j}" for j in range(40))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_few_texts_in_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_NGRAMS", 60)
    rows = []
    for c in range(20):
        words = [f"c{c}w{k}" for k in range(100)]
        rows += [(10 * c + k, " ".join([*words, f"c{c}x{k}"])) for k in range(2 + c % 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_first_of_each_class(spark, odd):
    out = op.first_of_each_class(odd)
    assert out.columns == odd.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == sorted({(str(r.doc_id), r.text) for r in odd.collect() if r.text})
    rows = [(k, " ".join(f"w{j}" for j in range(60))) for k in (9, 4, 7)] + [(1, "alone here with five words"), (2, None), (3, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in op.first_of_each_class(docs).collect()) == [1, 2, 3, 4]


def test_bands():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.99), (1.0, 0.999)):
        bands, rows = op.choose_bands(threshold, recall)
        assert bands * rows <= op.MAX_HASHES and 1 - (1 - threshold**rows) ** bands >= recall - 1e-9


def test_recall_of_the_bands():
    rng, (bands, rows), hit = np.random.default_rng(1), op.choose_bands(0.8, 0.9995), 0
    for _ in range(300):
        s = rng.integers(0, 1 << 64, 220, np.uint64)
        a, b = np.sort(s[:198]), np.sort(s[22:])
        hit += bool((op.band_hashes(a, bands, rows) == op.band_hashes(b, bands, rows)).any())
    assert hit >= 298


def test_hashes_depend_on_words_and_order():
    words, sizes = word_hashes(["Ab  cd\tab", None, " ", "cd AB é"])
    assert sizes.tolist() == [3, 0, 0, 3]
    assert words[0] == words[2] == words[4] and words[1] == words[3] != words[0]
    assert ngram_hashes(words[:2], 5)[0] != ngram_hashes(words[1:3], 5)[0]


def test_chains_are_not_compared_end_to_end(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_NODES", 10)
    words = [f"w{k}" for k in range(4000)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 60])) for k in range(400)]
    rows += [(1000 + k, " ".join(words[8 * k : 8 * k + 60]) + " end") for k in range(0, 400, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands, width = op.choose_bands(op.THRESHOLD, op.RECALL)
    signed = op._signatures(docs, op.N, bands, width)
    nodes = signed.groupBy("key").agg(F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.max("n_ngrams").alias("n_ngrams"), F.first("bands").alias("bands")).cache()
    groups = op.components(op._ties(nodes))
    assert groups.groupBy("label").count().agg(F.max("count")).first()[0] > 100
    placed, deals = op.blocks(nodes, groups)
    assert placed.count() == len(rows) and placed.join(deals, "block").count() < 12 * len(rows)
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 30
    assert found(docs) == brute(rows)

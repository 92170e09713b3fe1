"""Operator 2: alignment against the plain recurrence, and planted copies of items."""

import random

import numpy as np
import pytest

from muxlake.llm import op2_decontamination as op


def plain_score(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for a in range(1, len(item) + 1):
        for b in range(1, len(passage) + 1):
            d = op.MATCH if item[a - 1] == passage[b - 1] else op.MISMATCH
            h[a, b] = max(0, h[a - 1, b - 1] + d, h[a - 1, b] + op.GAP, h[a, b - 1] + op.GAP)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(20):
        item = rng.integers(1, 6, rng.integers(1, 15)).astype(np.int32)
        rows = rng.integers(0, 6, (5, 30)).astype(np.int32)
        rows[0, 10:] = -1
        score, _ = op.smith_waterman(item, rows)
        assert score.tolist() == [plain_score(item, r) for r in rows]


def brute(docs, items, threshold=0.5):
    """Every item against every whole text."""
    out = set()
    for d, text in docs:
        words = op.words_of(text)
        for i, t in items:
            own = op.words_of(t)
            if own and words:
                codes = {w: k for k, w in enumerate(dict.fromkeys(own), 1)}
                score, _ = op.smith_waterman(np.array([codes[w] for w in own], np.int32), np.array([[codes.get(w, 0) for w in words]], np.int32))
                if score[0] >= threshold * op.MATCH * len(own):
                    out.add((d, i))
    return out


def test_planted_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(prose(40))) for k in range(30)] + [(90, None), (91, " "), (92, "two words")]
    docs = []
    for k in range(60):
        body = items[k % 30][1].split() if k < 45 else prose(40)
        if k >= 15:
            for at in rng.sample(range(40), 5):
                body[at] = word()
        if k >= 30:
            del body[18:20]
        docs.append((k, " ".join(prose(100) + body + prose(100))))
    docs += [(70, None), (71, ""), (None, items[3][1].upper()), (72, items[4][1]), (72, items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = op.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
    assert {(k, k % 30) for k in range(45)} <= {(r.doc_id, r.item_id) for r in rows}
    clean = op.without_leaks(frame, bench)
    assert {r.doc_id for r in clean.collect()} == {*range(45, 60), 70, 71}


@pytest.mark.parametrize("step", [4, 5])
def test_every_few_words_edited(spark, step):
    rng = random.Random(step)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(prose(40))) for k in range(10)]
    docs = []
    for k in range(10):
        for phase in {0, k % step} if k % 2 else {k % step}:
            body = [f"new{j}" if j % step == phase else x for j, x in enumerate(items[k][1].split())]
            docs += [(100 * k + 10 * phase + j, " ".join(prose(60) + body + prose(60))) for j in range(1 if phase else 3)]
    rows = op.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(d, d // 100) for d, _ in docs} <= want
    assert {(r.doc_id, r.item_id) for r in rows} == want


def test_common_items_have_seeds_too(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"x{k} {text} y{k}") for k in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert op.find_leaks(docs, bench).count() == 300


def test_common_runs_lose_nothing(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(["which", "of", "the", "following", *prose(rng.randint(2, 24))])) for k in range(40)]
    docs = []
    for k in range(120):
        body = items[rng.randrange(40)][1].split()
        for at in range(4, len(body)):
            if rng.random() < 0.45:
                body[at] = rng.choice(vocabulary)
        docs.append((k, " ".join(prose(30) + body + prose(30))))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for many in (0, 8, 10**9):
        monkeypatch.setattr(op, "MANY_ITEMS", many)
        monkeypatch.setattr(op, "MANY_DOCS", many)
        found[many] = sorted((r.doc_id, r.item_id, r.score) for r in op.find_leaks(frame, bench).collect())
    assert found[0] == found[8] == found[10**9] and len(found[0]) > 40


def test_many_items_with_a_common_run_cost_little(spark):
    import time

    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    docs = spark.createDataFrame([(k, f"{prose(40)} which of the following {prose(40)}") for k in range(300)], "doc_id long, text string")
    took = {}
    for n in (20, 20, 3000):
        bench = spark.createDataFrame([(k, f"which of the following {prose(20)}") for k in range(n)], "item_id long, text string")
        began = time.time()
        assert op.find_leaks(docs, bench).count() == 0
        took[n] = time.time() - began
    assert took[3000] < 4 * took[20] + 6


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(table, request, spark):
    docs = request.getfixturevalue(table)
    bench = spark.createDataFrame([(1, "the same row twice with a few more words"), (2, None)], "item_id long, text string")
    rows = op.find_leaks(docs, bench).collect()
    assert [r.doc_id for r in rows] == ([4, 4] if table == "odd" else [])
    assert op.without_leaks(docs, bench).columns == docs.columns
    assert op.find_leaks(docs, bench.where("item_id = 2")).count() == 0


def test_blocks_of_items_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(op, "CELLS", 3000)
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(n))
    items = [(k, prose(30)) for k in range(25)] + [(50, prose(4000))]
    docs = [(k, f"{prose(20)} {items[k][1]} {prose(20)}") for k in range(25)] + [(50, items[25][1]), (60, prose(200))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(op.item_blocks(bench, 500)) == 10
    pairs = lambda n: sorted((r.doc_id, r.item_id, r.score) for r in op.find_leaks(frame, bench, block_words=n).collect())
    assert pairs(500) == pairs(10**9) and {(d, i) for d, i, _ in pairs(500)} >= {(k, k) for k in [*range(25), 50]}

"""Operator 12: brute force over vectors with ties, repeated rows, nulls and other lengths."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from muxlake.llm import op12_hard_negatives as op

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, n_pos=op.N_POSITIVES, n_neg=op.N_NEGATIVES):
    """The contract, row by row."""
    known = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in known:
        if i % 100:
            continue
        others = sorted((-dot(v, w), j, m) for j, m, w in known if j != i)
        for p, j, _ in [x for x in others if x[2] == label][:n_pos]:
            fit = [(s, k) for s, k, m in others if m != label and 30 * -p <= 100 * -s <= 90 * -p][:n_neg]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, op.mine(df.repartition(3), F.col("vec_id") % 100 == 0, moved, **more).collect()))


def vectors(n, dims, labels, seed, spread=1.0, copies=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    rows = [(int(k), int(rng.integers(labels)), [float(x) for x in centre[k % 4] + spread * rng.normal(size=dims)]) for k in range(n)]
    return rows + [(n + k, int(rng.integers(labels)), rows[5][2]) for k in range(copies)]


@pytest.mark.parametrize("sample,spread", [(1, 1.0), (3000, 0.4)])
def test_brute_force(spark, sample, spread, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_ROWS", 40)
    rows = vectors(500, 8, 4, 3, spread, copies=150)
    found = mined(spark, rows, sample=sample)
    assert len(found) > 100 and found == brute(rows)


def test_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP_BYTES", 500)
    monkeypatch.setattr(op, "CHUNK_ROWS", 2)
    rows = [(i * 25, label, v) for i, label, v in vectors(60, 4, 3, 8)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(230, 3, 3, 4)
    rows += [(100, 1, rows[7][2]), (100, 1, rows[7][2]), (200, 2, [0.5]), (300, 1, []), (400, 0, [0.1, 0.2, 0.3, 0.4, 9.0])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (500, None, [1.0] * 3), (600, 1, None), (700, 1, [1.0, None, 2.0]), (800, 1, [1.0, math.nan, 1.0]), (900, 2, [math.inf, 0.0, 1.0])]
    assert mined(spark, rows) == brute(rows)


def test_small_and_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []
    rows = [(0, 1, [1.0, 1.0]), (1, 2, [1.0, 1.0]), (2, 2, [1.0, 1.0]), (3, 5, [0.5, 0.5]), (4, 5, [0.5, 0.5])]
    assert mined(spark, rows) == brute(rows) != []


def test_large_scores_are_exact(spark):
    rows = [(k * 50, k % 2, [float(x) for x in np.random.default_rng(k).integers(1, 2**20, 6)]) for k in range(12)]
    assert mined(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="fit a long"):
        mined(spark, [(k, 1, [1e30, 1e30]) for k in range(3)])


def test_query_and_sql(spark):
    out = op.query(spark, "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    asked = con.execute(op.ORACLE_SQL)
    assert [d[0] for d in asked.description] == out.columns
    assert sorted(asked.fetchall()) == sorted(map(tuple, out.collect()))


def test_clashing_columns(spark):
    rows = vectors(120, 3, 2, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("v", "d", "cell", "near", "anchor", "rank", "score", "id", "place", "a.b"))))
    assert sorted(map(tuple, op.mine(more, F.col("vec_id") % 100 == 0).collect())) == sorted(map(tuple, op.mine(df, F.col("vec_id") % 100 == 0).collect()))

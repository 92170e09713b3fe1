"""Series of rates, packets of binary columns, and other operators that no query covers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from muxlake.functions import values
from muxlake.operators import analyzer, catalog, compare, packets
from muxlake.operators import descriptors as desc

START = datetime(2024, 1, 1)


def test_merged_points(spark):
    rng, rows = random.Random(1), []
    for source in ("a", "b", None):
        at = 0
        for _ in range(150):
            at += rng.choice([1, 40, 90, 200])
            rows.append((source, START + timedelta(milliseconds=at), float(rng.randrange(100)) if rng.random() < 0.95 else None))
    want = []
    for source in ("a", "b", None):
        group = None
        for _, t, v in (r for r in rows if r[0] == source and r[2] is not None):
            if group is None or t - group[1] > timedelta(milliseconds=150):
                group = [source, t, 0.0, 0]
                want.append(group)
            group[2] += v
            group[3] += 1
    shuffled = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "source string, ts timestamp, bps double").repartition(6)
    got = analyzer.merged_points(shuffled).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(want) > 60
    assert analyzer.merged_points(shuffled.where("false")).count() == 0


def test_rates_of_series(spark):
    rows = [("s", 1, 188 * 10, 27_000_000, 4e6, 2e6, START), ("s", 1, 188 * 20, 27_000_000, 8e6, 4e6, START + timedelta(minutes=2)), ("s", 2, 100, 27_000_000, 1e6, 1e6, START + timedelta(minutes=5)), ("s", None, 999, 5, 2e6, 1e6, START + timedelta(minutes=4))]
    df = spark.createDataFrame(rows, "source string, pid int, n_bytes long, ticks long, bps double, useful_bps double, ts timestamp").withColumn("byte_offset", F.lit(7))
    means = {r.pid: (r.n_windows, r.mean_mbps, r.mean_useful_mbps, r.max_mbps) for r in analyzer.average_rates(df).collect()}
    assert means == {1: (2, 6.0, 3.0, 8.0), 2: (1, 1.0, 1.0, 1.0), None: (1, 2.0, 1.0, 2.0)}
    assert sorted((r.pid, r.n_packets, r.delta_ticks) for r in analyzer.legacy_rates(df).collect()) == [(1, 10, 27_000_000), (1, 20, 27_000_000)]
    assert sorted(r.n_bytes for r in analyzer.kept(df).collect()) == [100, 999, 3760]


def test_packetize(spark):
    data = bytes(range(256)) * 5
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(100)), ("c", None)], "source string, d binary")
    for size in (188, 204):
        got = packets.packetize(df, "d", size).orderBy("byte_offset").collect()
        assert [(r.source, r.byte_offset, bytes(r.raw)) for r in got] == [("a", k * size, data[k * size : k * size + 188]) for k in range(len(data) // size)]
    with pytest.raises(ValueError):
        packets.packetize(df, "d", 100)


def test_routes_clocks_and_keys(spark):
    rows = spark.createDataFrame([(0,), (0x11,), (0x15,), (0x100,)], "pid int").select(packets.route(F.col("pid"))).collect()
    assert [r[0] for r in rows] == ["PAT", "SDT/BAT", "MIP", None]
    assert spark.range(1).select(values.clock_time(F.lit(27_000_000 * 90 + 27)).alias("t")).first().t == timedelta(seconds=90, microseconds=1)
    keys = desc.group_key(spark.createDataFrame([("dvb", 0x4D, None), ("ext", 0x7F, 4)], "family string, tag int, ext_tag int")).orderBy("tag").collect()
    assert [k.group for k in keys] == ["Dvb_4D", "Ext_7F_ext04"]


def test_candidates_and_corpus(spark):
    rows = [("s", 200 + k, False) for k in range(120)] + [("s", 8191, False), ("s", 300, True), ("t", 400, False), ("t", 400, False)]
    got = catalog.candidate_pids(spark.createDataFrame(rows, "source string, pid int, tei boolean"), 5).orderBy("source", "pid").collect()
    assert [tuple(r) for r in got] == [("s", p) for p in range(256, 261)] + [("t", 400)]
    same = spark.createDataFrame([("g", bytearray(b"a")), ("g", bytearray(b"a")), ("g", bytearray(b"b")), ("h", bytearray(b"a"))], "g string, data binary")
    assert [tuple(r) for r in compare.corpus_stats(same, "g", "data").orderBy("g").select("g", "available", "n_unique").collect()] == [("g", 3, 2), ("h", 1, 1)]

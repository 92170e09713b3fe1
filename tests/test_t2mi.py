"""PLPs: packets out of baseband frames of all kinds, over ranges, torn and lost frames, and micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from muxlake.operators import packets, t2mi
from muxlake.streaming import live
from tests.test_live import Muxer, streamed

FRAMES = "source string, pid int, first_offset bigint, place int, plp_id int, ts_gs int, single_input boolean, issy boolean, null_deleted boolean, upl int, dfl int, sync int, syncd int, mode int, data binary"


def crc8(data):
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c << 1 ^ (0xD5 if c & 0x80 else 0)) & 0xFF
    return c


def inner(rng, n, deleted):
    """(packet, null packets in front of it)"""
    return [(b"\x47" + rng.randbytes(187), rng.choice([0, 0, 0, 1, 3]) if deleted else 0) for _ in range(n)]


def framed(rng, own, mode, deleted, issy, low=40, high=900):
    """(data, syncd) of frames that carry packets, cut anywhere."""
    units, last = [], 0
    for packet, nulls in own:
        head = b"" if mode else bytes([last])
        last = crc8(packet[1:])
        units.append(head + packet[1:] + (b"" if mode else rng.randbytes(issy)) + (bytes([nulls]) if deleted else b""))
    stream, size = b"".join(units), len(units[0])
    out, at = [], 0
    while at < len(stream):
        data = stream[at : at + rng.randint(low, high)]
        syncd = -at % size
        out.append((data, syncd * 8 if syncd < len(data) else 0xFFFF))
        at += len(data)
    return out, size


def rows(source, plp, frames, mode, deleted, issy, size, step=1000):
    return [
        (source, 4096, k // 2 * step, k % 2, plp, 3, True, issy > 0, deleted, 0 if mode else size * 8, len(data) * 8, 0 if mode else 0x47, syncd, mode, bytearray(data))
        for k, (data, syncd) in enumerate(frames)
    ]


def expected(own):
    return [p for packet, nulls in own for p in [t2mi.NULL_PACKET] * nulls + [packet]]


def by_plp(df):
    out = {}
    for r in df.orderBy("source", "pid", "plp_id", "byte_offset").collect():
        out.setdefault((r.source, r.plp_id), []).append((r.byte_offset, bytes(r.raw)))
    return out


KINDS = [(1, False, 0), (1, True, 0), (0, False, 0), (0, True, 0), (0, False, 2), (0, False, 3), (0, True, 2), (0, True, 3)]


@pytest.mark.parametrize("range_bytes", [1, 3000, 17_000, None])
def test_every_kind_of_frame_over_ranges(spark, range_bytes):
    rng, every, want = random.Random(3), [], {}
    for plp, (mode, deleted, issy) in enumerate(KINDS):
        own = inner(rng, 60, deleted)
        frames, size = framed(rng, own, mode, deleted, issy, 20, 120 if plp % 2 else 900)
        every += rows("s" if plp else None, plp, frames, mode, deleted, issy, size)
        want["s" if plp else None, plp] = [(k * 188, p) for k, p in enumerate(expected(own))]
    rng.shuffle(every)
    assert by_plp(t2mi.inner_packets(spark.createDataFrame(every, FRAMES), range_bytes)) == want


def test_lost_frames_and_frames_of_the_wrong_kind(spark):
    rng = random.Random(8)
    own = inner(rng, 200, True)
    frames, size = framed(rng, own, 1, True, 0, 30, 400)
    kept = [r for r in rows("s", 0, frames, 1, True, 0, size) if rng.random() > 0.1]
    sound = {p for p, _ in own} | {t2mi.NULL_PACKET}
    alone = t2mi.Stripper()
    want = [x for r in kept for x in alone.push(bytes(r[14]), r[12], r[9], r[13], r[8])] + alone.close()
    want = [p for _, nulls, packet in want for p in [t2mi.NULL_PACKET] * nulls + [packet]]
    assert set(want) <= sound and 50 < len(want) < len(expected(own))
    # Another stream type, a start behind the end, odd bits, a packet too short in normal mode.
    bad = [dict(ts_gs=0), dict(syncd=8 * 5000), dict(dfl=12), dict(mode=0, upl=187 * 8), dict(mode=0, upl=1504, issy=True), dict(mode=77)]
    names = [f.split()[0] for f in FRAMES.split(", ")]
    wrong = [tuple({**dict(zip(names, kept[5])), **b, "first_offset": kept[5][2], "place": 5 + k}.values()) for k, b in enumerate(bad)]
    for range_bytes in (1, 2500, None):
        found = by_plp(t2mi.inner_packets(spark.createDataFrame(kept + wrong, FRAMES), range_bytes))
        assert found == {("s", 0): [(k * 188, p) for k, p in enumerate(want)]}
    assert t2mi.inner_packets(spark.createDataFrame([], FRAMES)).count() == 0


def test_a_packet_that_its_last_frame_completes(spark):
    own = inner(random.Random(1), 2, True)
    frames, size = framed(random.Random(1), own, 1, True, 0, 150, 150)
    assert frames[-1][1] == 0xFFFF
    for range_bytes in (1, None):
        found = by_plp(t2mi.inner_packets(spark.createDataFrame(rows("s", 0, frames, 1, True, 0, size), FRAMES), range_bytes))
        assert [p for _, p in found["s", 0]] == expected(own)


def test_one_exchange_of_frames_and_no_window_over_them(spark):
    frames = spark.createDataFrame(rows("s", 0, framed(random.Random(1), inner(random.Random(1), 9, False), 1, False, 0)[0], 1, False, 0, 187), FRAMES)
    plan = t2mi.inner_packets(frames)._jdf.queryExecution().executedPlan().toString()
    for window in (line for line in plan.split("\n") if "Window" in line):
        assert "data#" not in window


def carrier(rng, plps, mux):
    """Frames of several PLPs, in turn, as T2-MI packets in a PID's payloads."""
    from tests.test_live import crc

    out, queue = [], [(plp, *frame) for turn in zip(*plps.values()) for plp, frame in zip(plps, turn)]
    for k, (plp, data, syncd) in enumerate(queue):
        head = b"\xc0\0\0\0" + (len(data) * 8).to_bytes(2, "big") + b"\0" + syncd.to_bytes(2, "big")
        body = bytes([0, plp, 0x80]) + head + bytes([crc8(head) ^ 1]) + data
        out.append(crc(bytes([0, k % 256, 0, 0]) + (len(body) * 8).to_bytes(2, "big") + body))
    # Packets back to back: each payload's pointer tells where the first packet begins in it.
    starts, stream = set(), b""
    for packet in out:
        starts.add(len(stream))
        stream += packet
    at = 0
    while at < len(stream):
        begun = [s for s in starts if at <= s < at + 183]
        n = 183 if begun else 184
        mux.raw(0x1000, (bytes([min(begun) - at]) if begun else b"") + stream[at : at + n], bool(begun))
        at += n
    return mux.out


def test_packets_frames_and_plps_on_a_stream(spark, tmp_path):
    rng, plps, want = random.Random(6), {}, {}
    for plp in (3, 5):
        own = inner(rng, 90, False)
        plps[plp], _ = framed(rng, own, 1, False, 0, 150, 700)
        want[plp] = expected(own)
    raws = carrier(rng, plps, Muxer())
    build = lambda p, m: m.inner_packets(t2mi.baseband_frames(m.carrier_packets(p).where("crc_ok")))
    fields = ["plp_id", "byte_offset", "raw"]
    found, batch = streamed(spark, tmp_path, raws, lambda p: build(p, live), [5, 40, 41, 90, 130], fields)
    whole = build(batch, t2mi).select(*fields).collect()
    assert found == sorted((tuple(r) for r in whole), key=str)
    for plp, packets_ in want.items():
        own = [bytes(r.raw) for r in sorted(whole, key=lambda r: r.byte_offset) if r.plp_id == plp]
        assert own == packets_[: len(own)] and len(own) > 50
    assert packets.decode(t2mi.plp_sources(build(batch, t2mi))).select("source").distinct().count() == 2
    carried = t2mi.carrier_packets(batch).where(F.col("crc_ok")).count()
    assert carried == sum(len(x) for x in zip(*plps.values()))

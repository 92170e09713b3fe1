"""Streams against batches: sections, changes, versions, announced tables and rates, with packets and sections torn over micro-batches."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from muxlake.operators import analyzer, packets, sections
from muxlake.streaming import live

PACKETS = "source string, byte_offset bigint, raw binary"


def crc(data: bytes) -> bytes:
    flip = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
    return data + int(f"{zlib.crc32(data.translate(flip)) ^ 0xFFFFFFFF:032b}"[::-1], 2).to_bytes(4, "big")


def table(table_id, extension, version, body, number=0, last=0):
    n = 5 + len(body) + 4
    return crc(bytes([table_id, 0xB0 | n >> 8, n & 255]) + extension.to_bytes(2, "big") + bytes([0xC1 | version << 1, number, last]) + body)


def pat(version, pids, number=0, last=0):
    return table(0, 1, version, b"".join((k + 1).to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for k, p in enumerate(pids)), number, last)


def pmt(program, version, streams):
    return table(2, program, version, b"\xe1\x00\xf0\x00" + b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d for t, p, d in streams))


class Muxer:
    def __init__(self):
        self.cc, self.out = {}, []

    def raw(self, pid, payload, starts):
        self.cc[pid] = (self.cc.get(pid, -1) + 1) % 16
        self.out.append(bytes([0x47, starts << 6 | pid >> 8, pid & 255, 0x10 | self.cc[pid]]) + payload.ljust(184, b"\xff"))

    def section(self, pid, section):
        data, first = b"\x00" + section, True
        while data:
            self.raw(pid, data[:184], first)
            data, first = data[184:], False

    def pcr(self, pid, clock, jump=False):
        self.cc.setdefault(pid, 0)
        field = bytes([183, 0x10 | jump << 7]) + (clock // 300 << 15 | 0x7E00 | clock % 300).to_bytes(6, "big")
        self.out.append(bytes([0x47, pid >> 8, pid & 255, 0x20 | self.cc[pid]]) + field.ljust(184, b"\xff"))


def streamed(spark, tmp_path, raws, build, cuts, fields):
    """The rows of a streaming query over packets that come in so many micro-batches, and those of a batch."""
    folder = str(tmp_path / "in")
    frame = lambda rows, at: spark.createDataFrame([("s", (at + k) * 188, bytearray(r)) for k, r in enumerate(rows)], PACKETS)
    borders = [0, *cuts, len(raws)]
    for a, b in zip(borders, borders[1:]):
        frame(raws[a:b], a).coalesce(1).write.mode("append").parquet(folder)
    live.use_state_store(spark)
    read = packets.decode(spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(folder))
    name = f"t{random.randrange(1 << 60)}"
    query = build(read).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((tuple(r) for r in spark.table(name).select(*fields).collect()), key=str), packets.decode(frame(raws, 0))


def si_stream():
    rng, mux = random.Random(4), Muxer()
    versions = {}
    for k in range(60):
        kind = rng.choice([0x40, 0x42, 0x4A])
        pid, slot = {0x40: 0x10, 0x42: 0x11, 0x4A: 0x11}[kind], rng.randrange(3)
        versions[kind, slot] = versions.get((kind, slot), 0) + (rng.random() < 0.4)
        body = rng.randbytes(3) if kind == 0x42 else b""
        body = (slot.to_bytes(2, "big") + b"\xff") if kind == 0x42 else b"\xf0\x00\xf0\x00"
        mux.section(pid, table(kind, slot, versions[kind, slot] % 32, body + bytes(rng.choice([0, 170, 400]))))
    return mux.out


FIELDS = ["pid", "first_offset", "place", "section"]


def test_sections_changes_and_versions_follow_each_other(spark, tmp_path):
    raws = si_stream()
    cuts = [7, 31, 50]
    found, batch = streamed(spark, tmp_path / "a", raws, live.sections, cuts, FIELDS)
    whole = sections.reassemble(batch).cache()
    rows = lambda df: sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=str)
    assert found == rows(whole) and len(found) == 60
    found, _ = streamed(spark, tmp_path / "b", raws, lambda p: live.changed_tables(live.sections(p)), cuts, FIELDS)
    assert found == rows(sections.changed(whole)) and 10 < len(found) <= 60
    found, _ = streamed(spark, tmp_path / "c", raws, lambda p: live.new_versions(live.sections(p).where("table_id = 64"), "NIT"), cuts, FIELDS)
    nit = whole.where("table_id = 64").withColumns({"slot": F.hex(F.substring("section", 4, 2)), "version": F.shiftright(F.conv(F.hex(F.substring("section", 6, 1)), 16, 10).cast("int"), 1) % 32})
    assert found == rows(sections.versioned(nit, ["slot"])) and len(found) > 3


def announced_stream():
    mux = Muxer()
    private = bytes([0x6F, 3, 0, 1, 0])
    for k in range(6):
        mux.section(0x200, pmt(2, 0, [(0x02, 0x210, b"")]))  # not announced yet
        mux.section(0, pat(0, [0x100]))
        mux.section(0x100, pmt(1, 0, [(0x02, 0x110, b""), (0x86, 0x120, b""), (0x05, 0x130, private)]))
        mux.section(0x120, table(0x80, k, 0, bytes(300)))
        mux.section(0x130, table(0x74, k, 0, bytes(20)))
        mux.raw(0x110, b"\x00\x00\x01\xe0" + bytes(100), True)
    mux.section(0, pat(1, [0x100, 0x200]))
    for k in range(5):
        mux.section(0x200, pmt(2, 0, [(0x05, 0x230, b"")]))
        mux.section(0x230, table(0x90, k, 0, bytes(400)))
        mux.section(0x120, table(0x80, 100 + k, 0, bytes(10)))
    mux.section(0x100, pmt(1, 1, [(0x02, 0x110, b"")]))  # no cues any more
    mux.section(0x120, table(0x80, 200, 0, bytes(10)))
    mux.section(0, pat(2, [0x200]))
    mux.section(0x100, pmt(1, 2, [(0x86, 0x120, b"")]))
    mux.section(0x230, table(0x90, 50, 0, bytes(40)))
    return mux.out


def test_announced_tables(spark, tmp_path):
    raws = announced_stream()
    fields = ["kind", *FIELDS]
    found, batch = streamed(spark, tmp_path, raws, live.announced_sections, [5, 23, 24, 41, 60, 77], fields)
    known, want = live.Announced(), []
    for r in batch.orderBy("byte_offset").collect():
        want += known.push(r.pid, r.byte_offset, r.cc, r.pusi, bool(r.discontinuity), bytes(r.payload))
    assert found == sorted(want, key=str)
    n = {}
    for kind, pid, *_ in found:
        n[kind, pid] = n.get((kind, pid), 0) + 1
    assert n == {("PAT", 0): 8, ("PMT", 0x100): 7, ("SCTE-35", 0x120): 11, ("AIT", 0x130): 6, ("PMT", 0x200): 5, ("EWS", 0x230): 6}


def test_announced_from_the_start_equals_batch(spark, tmp_path):
    raws = announced_stream()[6:40]
    found, batch = streamed(spark, tmp_path, [r for r in raws if int.from_bytes(r[1:3], "big") & 0x1FFF != 0x200], live.announced_sections, [9], FIELDS)
    known = {0, 0x100, 0x120, 0x130}
    every = sections.reassemble(batch).where(F.col("pid").isin(*known)).select(*FIELDS).collect()
    late = sorted((tuple(r) for r in every), key=str)
    assert set(found) <= set(late) and len(found) > 10


@pytest.mark.parametrize("per_pid", [False, True])
def test_rates(spark, tmp_path, per_pid):
    rng, mux, clock = random.Random(5), Muxer(), (1 << 33) * 300 - 30_000_000
    for k in range(500):
        clock = (clock + rng.randrange(300_000)) % ((1 << 33) * 300)
        pid = rng.choice([7, 7, 8, 9, 10 if k > 250 else 8, 0x1FFF])
        if pid in (7, 9) and rng.random() < 0.6:
            mux.pcr(pid, clock, rng.random() < 0.03)
        elif rng.random() < 0.05 and pid == 8:
            mux.pcr(8, clock, True)
        else:
            mux.raw(pid, b"x", False)
    options = analyzer.RateOptions(window_sec=0.2)
    fields = ["pid", "byte_offset", "n_bytes", "n_useful", "ticks"]
    found, batch = streamed(spark, tmp_path, mux.out, lambda p: live.rate_windows(p, options, per_pid), [3, 130, 260, 261, 400], fields)
    want = sorted((tuple(r) for r in analyzer.bitrate(batch, options, per_pid).select(*fields).collect()), key=str)
    assert found == want and len(found) > 5

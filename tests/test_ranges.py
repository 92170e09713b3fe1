"""Work in ranges against the same work in one piece, and against packet-by-packet state."""

import random

import pytest
from pyspark.sql import functions as F

from muxlake.functions.bits import be, join
from muxlake.operators import analyzer, packets, sections
from muxlake.operators.ranges import with_number, with_previous
from muxlake.plans import mux
from muxlake.streaming.live import Assembler

RANGES = [188 * 3, 188 * 17, 1 << 30]


@pytest.fixture(scope="module")
def stream(spark):
    """Sections of all sizes on five PIDs, PES on one; some packets lost, doubled, flagged, and some pointers at odd places."""
    rng = random.Random(11)
    rows, cc, at = [], {}, 0
    open_ = {p: b"" for p in range(5)}
    for _ in range(700):
        pid = rng.randrange(6)
        if pid == 5:
            starts, payload = rng.random() < 0.3, rng.randbytes(184)
            payload = (b"\0\0\1\xe0" + payload)[:184] if starts else payload
        else:
            left, starts, payload = open_[pid], False, b""
            fresh = b""
            if len(left) < 183:
                starts, fresh = True, b""
                while len(fresh) < 200 and rng.random() < 0.8:
                    n = rng.choice([5, 30, 120, 500])
                    fresh += bytes([0x80, 0x30 | n >> 8, n & 255]) + rng.randbytes(n)
                payload = bytes([len(left)]) + left + fresh[: 183 - len(left)]
                open_[pid] = fresh[183 - len(left) :]
                payload += b"\xff" * (184 - len(payload))
            else:
                payload, open_[pid] = left[:184], left[184:]
                payload += b"\xff" * (184 - len(payload))
        cc[pid] = (cc.get(pid, 3) + 1) % 16
        if rng.random() < 0.03:
            continue
        rows.append((at, pid, cc[pid], int(starts), payload, rng.random() < 0.02))
        at += 188
        if rng.random() < 0.02:
            rows.append((at, pid, cc[pid], int(starts), payload, False))
            at += 188
    made = spark.createDataFrame(rows, "byte_offset long, pid int, cc int, pusi int, payload binary, jump boolean")
    raw = made.select(F.lit("t").alias("source"), "byte_offset", mux.packet(F.col("pid"), F.col("cc"), F.col("payload"), F.col("pusi")).alias("raw"), "jump")
    decoded = packets.decode(raw).join(made.select("byte_offset", "jump"), "byte_offset").drop("discontinuity").withColumnRenamed("jump", "discontinuity")
    return decoded.cache()


def one_by_one(rows):
    out, assemblers = [], {}
    for r in sorted(rows, key=lambda r: r.byte_offset):
        if r.payload is not None and r.pid != 5:
            a = assemblers.setdefault(r.pid, Assembler())
            out += [(r.pid, *x) for x in a.push(r.byte_offset, r.cc, r.pusi, r.discontinuity, bytes(r.payload))]
    return sorted(out)


@pytest.mark.parametrize("size", RANGES)
def test_sections_in_ranges(stream, size):
    got = sections.reassemble(stream, range_bytes=size).where("pid <> 5").collect()
    want = one_by_one(stream.collect())
    assert len(want) > 150 and sorted((r.pid, r.first_offset, r.place, bytes(r.section)) for r in got) == want


def test_sections_of_chosen_pids(stream, spark):
    pids = spark.createDataFrame([("t", 1), ("t", 3), ("u", 2)], "source string, pid int")
    assert {r.pid for r in sections.reassemble(stream, pids).collect()} == {1, 3}


@pytest.mark.parametrize("size", RANGES)
def test_counters_in_ranges(stream, size):
    rows = sorted(stream.collect(), key=lambda r: r.byte_offset)
    last, wrong = {}, []
    for r in rows:
        step = (r.cc - last[r.pid]) % 16 if r.pid in last else 1
        if step != 1 and (step or r.has_payload):
            wrong.append((r.pid, r.byte_offset))
        last[r.pid] = r.cc
    got = analyzer.continuity(stream, size).where("is_error").collect()
    assert sorted((r.pid, r.byte_offset) for r in got) == sorted(wrong)
    stats = {r.pid: (r.n_packets, r.cc_errors) for r in analyzer.pid_stats(stream, range_bytes=size).collect()}
    assert stats == {p: (sum(r.pid == p for r in rows), sum(w[0] == p for w in wrong)) for p in last}


def test_numbers_and_previous(spark):
    rows = [(k, k % 3, f"v{k}") for k in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "byte_offset long, pid int, v string")
    got = with_previous(with_number(df, ["pid"], size=11), ["pid"], ["v"], size=7).collect()
    for p in range(3):
        own = [r for r in rows if r[1] == p]
        want = [(o, k, own[k - 1][2] if k else None) for k, (o, _, _) in enumerate(own)]
        assert sorted((r.byte_offset, r.number, r.before.v if r.before else None) for r in got if r.pid == p) == want


def plain_rates(rows, window, per_pid, width=42):
    """Windows packet by packet."""
    state, reference, out = {}, None, []
    if not per_pid:
        state[None] = [None, 0]
    for r in rows:
        key = r.pid if per_pid else None
        own = state.setdefault(key, [None, 0])
        own[1] += 188
        if reference is None and r.pcr is not None:
            reference = r.pid
        if r.discontinuity:
            if r.pid == reference:
                for s in state.values():
                    s[:] = [None, 0]
            elif per_pid:
                own[:] = [None, 0]
        if r.pcr is None or r.pid != reference:
            continue
        for pid, s in state.items():
            delta = (r.pcr - s[0]) % (1 << width) if s[0] is not None else -1
            if s[0] is None:
                s[0] = r.pcr
            elif s[1] and delta >= window:
                out.append((pid, r.byte_offset, s[1], delta))
                s[:] = [r.pcr, 0]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", RANGES)
@pytest.mark.parametrize("per_pid", [False, True])
def test_rates_in_ranges(spark, size, per_pid):
    rng = random.Random(3)
    rows, clock = [], (1 << 42) - 30_000_000
    for k in range(500):
        clock += rng.randrange(400_000)
        pid = rng.choice([7, 7, 8, 8, 9, 10 if k > 250 else 8])
        rows.append((k * 188, pid, clock % (1 << 42) if pid in (7, 9) and rng.random() < 0.6 else None, rng.random() < (0.01 if pid == 7 else 0.05)))
    df = spark.createDataFrame(rows, "byte_offset long, pid int, pcr long, discontinuity boolean").selectExpr("'s' AS source", "*", "false AS tei")
    want = plain_rates(df.collect(), 5_400_000, per_pid)
    got = analyzer.bitrate(df, analyzer.RateOptions(window_sec=0.2), per_pid, size).collect()
    assert len(want) > 8 and sorted(((r.pid, r.byte_offset, r.n_bytes, r.ticks) for r in got), key=str) == want


def test_versions(spark):
    rows = [(k * 188, 0, s, v) for k, (s, v) in enumerate([(1, 0), (2, 0), (1, 1), (1, 1), (2, 0), (1, 0), (2, 5), (1, 0)])]
    df = spark.createDataFrame(rows, "first_offset long, place int, slot int, version int").selectExpr("'s' AS source", "5 AS pid", "*")
    got = sections.versioned(df, ["slot"]).collect()
    assert sorted((r.slot, r.version, r.first_offset // 188) for r in got) == [(1, 0, 0), (1, 0, 5), (1, 1, 2), (2, 0, 1), (2, 5, 6)]
    crcs = df.selectExpr("*", "cast(version AS bigint) AS crc32", "true AS crc_ok")
    assert [r.first_offset // 188 for r in sections.changed(crcs).orderBy("first_offset").collect()] == [0, 2, 4, 6, 7]


def test_large_clock_field(spark):
    field = join(be(0x10, 1), mux.pcr_field(F.lit((1 << 33) * 300 - 1)))
    row = packets.decode(spark.range(1).select(F.lit("x").alias("source"), F.lit(0).cast("long").alias("byte_offset"), mux.packet(99, 0, be(7, 4), 0, field).alias("raw"))).first()
    assert row.pcr == (1 << 33) * 300 - 1


@pytest.mark.parametrize("what", ["continuity", "clock_steps", "assumed_bitrate", "bitrate", "bitrate_per_pid", "sync_losses"])
def test_packets_are_scanned_once(spark, tmp_path_factory, what):
    from muxlake.plans import queries

    folder = str(tmp_path_factory.mktemp("scanned") / "p")
    queries.event_packets(spark, "/root/testdata/sf0.001").write.parquet(folder)
    p = packets.decode(spark.read.parquet(folder))
    df = {
        "continuity": lambda: analyzer.continuity(p), "clock_steps": lambda: analyzer.clock_steps(p), "assumed_bitrate": lambda: analyzer.assumed_bitrate(p, 1e6), "bitrate": lambda: analyzer.bitrate(p),
        "bitrate_per_pid": lambda: analyzer.bitrate(p, per_pid=True), "sync_losses": lambda: packets.sync_losses(p),
    }[what]()
    assert len(df.collect()) > 0
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1, plan


@pytest.mark.parametrize("clock", ["pts", "dts"])
def test_other_clocks(spark, clock):
    rng = random.Random(6)
    rows, now = [], (1 << 33) - 400_000
    for k in range(400):
        now += rng.randrange(3000)
        rows.append((k * 188, rng.choice([7, 8]), now % (1 << 33) if rng.random() < 0.5 else None, False))
    df = spark.createDataFrame(rows, f"byte_offset long, pid int, {clock} long, discontinuity boolean").selectExpr("'s' AS source", "*", "false AS tei")
    want = plain_rates(df.withColumnRenamed(clock, "pcr").collect(), 18_000, True, 33)
    got = analyzer.bitrate(df, analyzer.RateOptions(clock=clock, window_sec=0.2), True).collect()
    assert len(want) > 8 and sorted(((r.pid, r.byte_offset, r.n_bytes, r.ticks) for r in got), key=str) == want


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_datagrams_in_ranges(spark, size):
    rng, at, want, rows = random.Random(2), {}, [], []
    for k in range(60):
        source, n, unit = rng.choice("ab"), rng.randrange(1, 5), rng.choice([188, 204])
        data = rng.randbytes(n * unit) if rng.random() < 0.8 else rng.randbytes(100)
        rows.append((source, k * 3, bytearray(data)))
        if len(data) > 100:
            begin = at.get(source, 0)
            want += [(source, begin + j * unit, data[j * unit : j * unit + 188]) for j in range(n)]
            at[source] = begin + len(data)
    df = spark.createDataFrame(rows, "source string, arrival int, datagram binary").repartition(5)
    got = packets.from_datagrams(df, range_size=size).collect()
    assert sorted((r.source, r.byte_offset, bytes(r.raw)) for r in got) == sorted(want)

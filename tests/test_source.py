"""The source against a sequential reading: ranges of many sizes, losses, noise, cut ends; and bounded batches of a stream."""

import random

import numpy as np
import pytest

from muxlake.sources import ts

SIZES = [0.0005, 0.002, 0.0077, 0.02, 0.05, 0.1, 0.3, 0.77, 2, 64]


def packet(k):
    """A packet without a sync byte but its first."""
    return b"\x47" + bytes([k >> 8 & 0x1F, k & 0xFF]).replace(b"\x47", b"\x48") + bytes([0x10]) + k.to_bytes(4, "big").replace(b"\x47", b"\x48") + b"\x11" * 180


def noise(n, seed):
    out = np.random.default_rng(seed).integers(0, 256, n, np.uint8)
    out[out == 0x47] = 0x48
    return out.tobytes()


def offsets(path, range_mb, **more):
    reader = ts.TsReader({"path": str(path), "range_mb": str(range_mb), **more})
    return [x for part in reader.partitions() for batch in reader.read(part) for x in zip(batch.column("byte_offset").to_pylist(), batch.column("raw").to_pylist())]


CASES = {
    "plain": lambda: [(packet(k), True) for k in range(3000)],
    "a byte more": lambda: [(packet(k), True) for k in range(1000)] + [(b"\x00", False)] + [(packet(k), True) for k in range(1000, 3000)],
    "noise between": lambda: [(noise(700, 1), False)] + [(packet(k), True) for k in range(40)] + [(noise(1_000_000, 2), False)] + [(packet(k), True) for k in range(700)] + [(noise(333, 3), False)],
    "cut end": lambda: [(packet(k), True) for k in range(1000)] + [(packet(9)[:100], False)],
    "many losses": lambda: [x for k in range(600) for x in ([(packet(k), True)] + ([(noise(1 + k % 90, k), False)] if k % 37 == 5 and k < 590 else []))],
    "204": lambda: [(packet(k) + bytes(16), True) for k in range(900)],
}


@pytest.mark.parametrize("name", CASES)
def test_ranges_neither_lose_nor_invent(tmp_path, name):
    parts, data, want = CASES[name](), b"", []
    for raw, is_packet in parts:
        if is_packet:
            want.append((len(data), raw[:188]))
        data += raw
    path = tmp_path / "a.ts"
    path.write_bytes(data)
    for size in SIZES:
        assert offsets(path, size) == want, size


def test_four_sync_bytes_are_asked_for(tmp_path):
    path = tmp_path / "a.ts"
    three = b"".join(packet(k) for k in range(3))
    path.write_bytes(b"".join(packet(k) for k in range(20)) + noise(1000, 4) + three + noise(5000, 5))
    assert [o for o, _ in offsets(path, 64)] == [k * 188 for k in range(20)]


def test_random_bytes_agree_between_ranges(tmp_path):
    rng = random.Random(8)
    data = b"".join(packet(k) if rng.random() < 0.97 else rng.randbytes(rng.randrange(400)) for k in range(4000))
    path = tmp_path / "a.ts"
    path.write_bytes(packet(0) * 5 + data)
    want = offsets(path, 64)
    assert len(want) > 3000 and all(offsets(path, size) == want for size in SIZES)


def test_short_and_unsynced_files(tmp_path):
    (tmp_path / "a.ts").write_bytes(packet(1) * 3)
    (tmp_path / "b.ts").write_bytes(noise(9000, 6))
    assert offsets(tmp_path, 0.002) == []
    assert len(offsets(tmp_path / "a.ts", 64, min_bytes="1")) == 0


def batches(reader):
    """The files of each batch until nothing is new."""
    start, out = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        out.append([p.path.rpartition("/")[2] for p in reader.partitions(start, end)])
        assert reader.partitions(start, end) == reader.partitions(start, end)
        start = end
    return start, out


def test_batches_are_bounded(tmp_path):
    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    for k in range(25):
        (folder / f"{k:03d}.ts").write_bytes(packet(k) * 12)
    options = {"path": str(folder), "max_files": "10", "log": str(log)}
    end, found = batches(ts.TsStreamReader(options))
    assert [len(b) for b in found] == [10, 10, 5] and end == {"list": 3}
    (folder / "000a.ts").write_bytes(packet(1) * 12)
    again = ts.TsStreamReader(options)  # a query that begins anew at the last offset of its checkpoint
    assert again.latestOffset() == {"list": 3} and again.latestOffset() == {"list": 4}
    assert [p.path[-7:] for p in again.partitions({"list": 3}, {"list": 4})] == ["000a.ts"]
    assert again.latestOffset() == {"list": 4}
    options = {"path": str(folder), "max_mb": str(12 * 188 * 4 / 1e6), "log": str(tmp_path / "other")}
    assert [len(b) for b in batches(ts.TsStreamReader(options))[1]] == [4] * 6 + [2]
    options = {"path": str(folder), "max_mb": "0.000001", "log": str(tmp_path / "third")}
    assert [len(b) for b in batches(ts.TsStreamReader(options))[1]] == [1] * 26
    with pytest.raises(ValueError):
        ts.TsStreamReader({"path": str(folder), "max_files": "3"})


def test_bounded_stream_equals_batch(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(30):
        (folder / f"{k % 7}-{k}.ts").write_bytes(b"".join(packet(k * 50 + j) for j in range(12 + k)))
    ts.register(spark)
    read = spark.readStream.format("ts").option("max_files", 4).option("log", str(tmp_path / "log")).load(str(folder))
    query = read.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(out)
    try:
        query.processAllAvailable()
        progress = [p for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()
    assert len(progress) == 8
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, spark.read.format("ts").load(str(folder)).collect()))

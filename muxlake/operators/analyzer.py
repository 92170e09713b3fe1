"""Measurements of packets: counts, continuity, clocks and bit rates.

A rate window closes at the first clock tick that is far enough from the one it began at, so windows depend on the data. Bytes are summed between
ticks first, in ranges of byte offsets; only the sums of PIDs that had bytes are folded, in order, a batch at a time, each source in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.functions.values import PCR_BITS, PCR_RATE, PTS_BITS, PTS_RATE
from muxlake.operators.packets import NULL_PID
from muxlake.operators.ranges import in_ranges, range_of, with_number, with_previous


def _wrong(last: Column, cc: Column, has_payload: Column) -> Column:
    """A repeated counter is an error where the packet has payload, any other jump always; a first packet and null packets have none."""
    step = F.pmod(cc - last, F.lit(16))
    return F.when(last.isNull() | (F.col("pid") == NULL_PID), False).when(step == 0, has_payload).otherwise(step != 1)


def continuity(packets: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """source, pid, byte_offset, cc and is_error of each packet that is not damaged."""
    rows = packets.where("NOT tei").select("source", "pid", "byte_offset", "cc", "has_payload")
    found = with_previous(rows, ["source", "pid"], ["cc"], size=range_bytes)
    return found.select("source", "pid", "byte_offset", "cc", _wrong(F.col("before.cc"), F.col("cc"), F.col("has_payload")).alias("is_error"))


def pid_stats(packets: DataFrame, packet_size: int = 188, range_bytes: int | None = None) -> DataFrame:
    """Packets, bytes and continuity errors of each PID; one pass over the packets, errors at the borders of ranges are added at the end."""
    rows = packets.where("NOT tei").select("source", "pid", "byte_offset", "cc", "has_payload", range_of("byte_offset", range_bytes).alias("range"))
    order = Window.partitionBy("source", "pid", "range").orderBy("byte_offset")
    marked = rows.withColumn("wrong", _wrong(F.lag("cc").over(order), F.col("cc"), F.col("has_payload")).cast("long"))
    parts = marked.groupBy("source", "pid", "range").agg(
        F.count("*").alias("n"), F.sum("wrong").alias("errors"), F.min_by(F.struct("cc", "has_payload"), "byte_offset").alias("first"), F.max_by("cc", "byte_offset").alias("last")
    )
    was = F.lag("last").over(Window.partitionBy("source", "pid").orderBy("range"))
    tied = parts.withColumn("errors", F.col("errors") + _wrong(was, F.col("first.cc"), F.col("first.has_payload")).cast("long"))
    return tied.groupBy("source", "pid").agg(
        F.sum("n").alias("n_packets"), (F.sum("n") * packet_size).alias("n_bytes"), F.sum("errors").alias("cc_errors")
    )


def pid_list(packets: DataFrame) -> DataFrame:
    return packets.where("NOT tei").select("source", "pid").distinct()


@dataclass(frozen=True)
class RateOptions:
    """What to measure: the clock (pcr, pts or dts), the window, the PID of the clock (None: the first that has one), null packets."""

    clock: str = "pcr"
    window_sec: float = 1.0
    reference_pid: int | None = None
    include_null: bool = False
    packet_size: int = 188

    def __post_init__(self):
        if self.clock not in ("pcr", "pts", "dts"):
            raise ValueError(f"no such clock: {self.clock}")
        if self.window_sec <= 0 or self.window_ticks <= 0:
            raise ValueError("a window is longer than a tick")

    @property
    def rate(self) -> int:
        return PCR_RATE if self.clock == "pcr" else PTS_RATE

    @property
    def width(self) -> int:
        return PCR_BITS if self.clock == "pcr" else PTS_BITS

    @property
    def window_ticks(self) -> int:
        return int(self.window_sec * self.rate)

    @property
    def tick(self) -> Column:
        return F.col(self.clock)


_SLOTS = "source string, slot bigint, tick bigint, reset boolean, sums array<struct<pid:int,n:bigint,useful:bigint,reset:boolean>>"
_WINDOWS = "source string, pid int, byte_offset bigint, n_bytes bigint, n_useful bigint, ticks bigint"


def slots(packets: DataFrame, options: RateOptions, per_pid: bool, range_bytes: int | None = None) -> DataFrame:
    """A row for each tick of a source's clock: slot (its byte offset), tick, reset, and the bytes since the tick before of each PID that had some.

    A packet belongs to the first tick at or behind it. A discontinuity on another PID than the clock's voids that PID's bytes so far in the slot. What lies
    behind the last tick of a range comes as a row without a tick. The packets are read once: each range becomes one array, and the clock's PID is found in the same arrays.
    """
    counted = packets.where("NOT tei") if options.include_null else packets.where((~F.col("tei")) & (F.col("pid") != NULL_PID))
    own = counted.select("source", "pid", "byte_offset", options.tick.cast("bigint").alias("tick"), F.coalesce("discontinuity", F.lit(False)).alias("jump"))
    ranges = in_ranges(own, ["source"], size=range_bytes)
    if options.reference_pid is not None:
        known = ranges.withColumn("reference", F.lit(options.reference_pid))
    else:
        first = F.get(F.filter("_rows", lambda r: r["tick"].isNotNull()), F.lit(0))
        clocks = ranges.select("source", first.alias("f")).where("f IS NOT NULL").groupBy("source").agg(F.min_by("f.pid", "f.byte_offset").alias("reference"))
        known = ranges.join(clocks, "source")
    return known.select("source", "reference", "_rows").mapInArrow(_slots_of(options.packet_size, per_pid), _SLOTS)


def _slots_of(size: int, per_pid: bool):
    """The slots of ranges: packets of one slot and PID are summed behind the PID's last discontinuity."""

    def of_range(reference: int, rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        get = lambda c, missing: pc.fill_null(rows.field(c), missing).to_numpy(zero_copy_only=False)
        pid, offset, tick, jump = get("pid", -1).astype(np.int64), get("byte_offset", 0), get("tick", -1), get("jump", False).astype(bool)
        clock = pid == reference
        events = np.flatnonzero(clock & ((tick >= 0) | jump))
        slot = np.searchsorted(events, np.arange(len(pid)))
        void = jump & ~clock if per_pid else np.zeros(len(pid), bool)
        key = pid if per_pid else np.zeros(len(pid), np.int64)
        order = np.lexsort((key, slot))
        group = np.flatnonzero(np.diff(slot[order], prepend=-1) | np.diff(key[order], prepend=-1))
        place = np.arange(len(pid))
        last = np.maximum.reduceat(np.where(void[order], place, -1), group)
        counts = place > np.repeat(last, np.diff(group, append=len(pid)))
        n = np.add.reduceat(counts, group) * size
        useful = np.add.reduceat(counts & (pid[order] != NULL_PID), group) * size
        heads = np.unique(slot[order][group], return_index=True)
        at = np.minimum(heads[0], max(len(events) - 1, 0))
        told = heads[0] < len(events)
        e = events[at] if len(events) else at
        return offset[np.where(told, e, len(offset) - 1)], np.where(told, tick[e], -1), told & jump[e], heads[1], key[order][group], n, useful, last >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, tick, reset, heads, pid, n, useful, void = of_range(batch.column("reference")[k].as_py(), batch.column("_rows")[k].values)
                no_pid = None if per_pid else np.ones(len(pid), bool)
                sums = pa.StructArray.from_arrays([pa.array(pid, pa.int32(), mask=no_pid), pa.array(n, pa.int64()), pa.array(useful, pa.int64()), pa.array(void)], ["pid", "n", "useful", "reset"])
                source = pa.array([batch.column("source")[k].as_py()] * len(at), pa.string())
                lists = pa.ListArray.from_arrays(pa.array([*heads, len(pid)], pa.int32()), sums)
                yield pa.RecordBatch.from_arrays([source, pa.array(at, pa.int64()), pa.array(tick, pa.int64(), mask=tick < 0), pa.array(reset), lists], ["source", "slot", "tick", "reset", "sums"])

    return run


def bitrate(packets: DataFrame, options: RateOptions | None = None, per_pid: bool = False, range_bytes: int | None = None) -> DataFrame:
    """A row for each window: its bytes, ticks, seconds and rate, for the stream (pid null) or for each PID.

    n_bytes counts what the options include; useful is what is not null packets. Bytes of the closing packet are in; a discontinuity on
    the clock's PID empties all windows, with the packet that tells it, and its tick begins new ones; on another PID it empties that PID's. A PID's first window
    begins at the first tick behind its first byte, and stays open while it has none.
    """
    options = options or RateOptions()
    found = slots(packets, options, per_pid, range_bytes)
    width = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(width, "source").sortWithinPartitions("source", "slot")
    closed = ordered.mapInArrow(_fold(options.window_ticks, options.width), _WINDOWS)
    seconds = F.col("ticks") / F.lit(float(options.rate))
    rate = lambda c: F.col(c) * F.lit(8.0) * F.lit(float(options.rate)) / F.col("ticks")
    return closed.select("source", "pid", "byte_offset", "n_bytes", "n_useful", "ticks", seconds.alias("seconds"), rate("n_bytes").alias("bps"), rate("n_useful").alias("useful_bps"))


def _fold(window: int, width: int):
    """Close windows over the ticks of sources, in order; the state is a window for each PID of the source at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, open_ = None, {}
        for batch in batches:
            out: list[tuple] = []
            for own, slot, tick, reset, sums in zip(*(batch.column(c).to_pylist() for c in ("source", "slot", "tick", "reset", "sums"))):
                if own != source:
                    source, open_ = own, {}
                for s in sums:
                    begin, n, useful = open_.get(s["pid"], (None, 0, 0))
                    open_[s["pid"]] = (None, s["n"], s["useful"]) if s["reset"] else (begin, n + s["n"], useful + s["useful"])
                if reset:
                    open_ = dict.fromkeys(open_, (None, 0, 0))
                if tick is None:
                    continue
                for pid, (begin, n, useful) in open_.items():
                    if begin is None:
                        open_[pid] = (tick, n, useful)
                    elif n and (delta := (tick - begin) % (1 << width)) >= window:
                        out.append((own, pid, slot, n, useful, delta))
                        open_[pid] = (tick, 0, 0)
            if out:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = ["source", "pid", "byte_offset", "n_bytes", "n_useful", "ticks"]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)

    return run


def average_rates(samples: DataFrame) -> DataFrame:
    """Mean and largest total and useful rate of each series, in Mbit/s."""
    mega = lambda c: F.col(c) / 1_000_000
    return samples.groupBy("source", "pid").agg(
        F.count("*").alias("n_windows"), F.avg(mega("bps")).alias("mean_mbps"), F.avg(mega("useful_bps")).alias("mean_useful_mbps"), F.max(mega("bps")).alias("max_mbps")
    )


def legacy_rates(samples: DataFrame, packet_size: int = 188) -> DataFrame:
    """Packets and clock ticks of each PID's window, as the older interface reports them; windows without either are left out."""
    n = F.floor(F.col("n_bytes") / packet_size).cast("long")
    return samples.where("pid IS NOT NULL").select("source", "pid", "byte_offset", n.alias("n_packets"), F.col("ticks").alias("delta_ticks")).where("n_packets > 0 AND delta_ticks > 0")


def kept(samples: DataFrame, time: str = "ts", keep: str = "3 minutes") -> DataFrame:
    """The points of each series that are not older than so long before the newest of all."""
    newest = samples.agg(F.max(time).alias("_newest"))
    return samples.join(F.broadcast(newest), F.col(time) >= F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_newest")


def assumed_bitrate(packets: DataFrame, bits_per_sec: float, window_sec: float = 1.0, packet_size: int = 188, range_bytes: int | None = None) -> DataFrame:
    """Windows of a stream without a clock, at a rate that is given: as many packets as fill one; the open rest is left out."""
    if bits_per_sec <= 0 or window_sec <= 0:
        raise ValueError("rate and window are positive")
    per_packet = int(packet_size * 8 * PCR_RATE / bits_per_sec)
    need = -(-int(window_sec * PCR_RATE) // per_packet)
    counted = packets.where((~F.col("tei")) & (F.col("pid") != NULL_PID)).select("source", "byte_offset")
    rows = with_number(counted, ["source"], size=range_bytes).select("source", "byte_offset", F.floor(F.col("number") / need).alias("window"))
    full = rows.groupBy("source", "window").agg(F.count("*").alias("n"), F.max("byte_offset").alias("byte_offset")).where(F.col("n") == need)
    ticks = int(need * packet_size * 8 * PCR_RATE / bits_per_sec)
    return full.select("source", "window", "byte_offset", F.lit(need * packet_size).cast("long").alias("n_bytes"), F.lit(ticks).cast("long").alias("ticks"))


def clock_steps(packets: DataFrame, clock: str = "pcr", range_bytes: int | None = None) -> DataFrame:
    """Each time stamp of a PID with the ticks since the one before, over the wrap."""
    options = RateOptions(clock=clock)
    timed = packets.where("NOT tei").select("source", "pid", "byte_offset", options.tick.alias("tick")).where("tick IS NOT NULL")
    found = with_previous(timed, ["source", "pid"], ["tick"], size=range_bytes)
    return found.withColumn("delta", F.pmod(F.col("tick") - F.col("before.tick"), F.lit(1 << options.width))).drop("before")


def merged_points(samples: DataFrame, time: str = "ts", value: str = "bps", gap_ms: int = 150) -> DataFrame:
    """Points of several series added up: a group takes what comes within so many milliseconds of its first point.

    A source's points come to one task in order, which holds a batch and the open group.
    """
    names = ["source", "at", "v", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, open_, begun = None, None, False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for own, at, v in zip(*(batch.column(c).to_pylist() for c in ("source", "at", "v"))):
                if not begun or own != source or at - open_[1] > gap_ms * 1000:
                    if begun:
                        out.append(tuple(open_))
                    source, open_, begun = own, [own, at, 0.0, 0], True
                open_[2] += v
                open_[3] += 1
            if out:
                yield made(out)
        if begun:
            yield made([tuple(open_)])

    rows = samples.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select("source", F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("v"))
    width = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(width, "source").sortWithinPartitions("source", "at").mapInArrow(run, "source string, at bigint, v double, n bigint")
    return found.select("source", F.timestamp_micros("at").alias("first_seen"), F.col("v").alias(value), F.col("n").alias("n_points"))


def sum_by_offset(samples: DataFrame, pids: list[int]) -> DataFrame:
    """The rates of chosen PIDs, added up at equal offsets."""
    return samples.where(F.col("pid").isin(pids)).groupBy("source", "byte_offset").agg(F.sum("bps").alias("bps"))


def sum_by_time(samples: DataFrame, time: str = "ts", value: str = "bps", width: str = "1 second") -> DataFrame:
    """Values added up in tumbling windows, with the first time in each."""
    return samples.groupBy(F.window(time, width).alias("w")).agg(F.sum(value).alias(value), F.min(time).alias("first_seen")).select(F.col("w.start").alias("bucket"), "first_seen", value)


def packet_types(t2mi: DataFrame) -> DataFrame:
    return t2mi.groupBy("packet_type").count()

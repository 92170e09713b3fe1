"""Streaming forms: the same decoding over packets as they arrive, with state where a result needs the past.

Arrival order is byte_offset within a source and PID; each micro-batch is put in that order before it meets the state, so a batch's rows of a key have to fit
a task: bound them where they are read (options max_files and max_mb of the source). What does not depend on the past (decoding, tables, descriptors) needs no
form of its own: the batch functions take streaming DataFrames. Sections, changes, versions, tables that others announce, rates, T2-MI packets and the streams inside them are
stateful processors, which may follow each other in one query; they need a state store of column families (use_state_store).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from muxlake.functions.bits import bits, part
from muxlake.operators import t2mi
from muxlake.operators.analyzer import RateOptions
from muxlake.operators.packets import NULL_PID, decode
from muxlake.operators.sections import MAX_LENGTH, NO_CRC, SECTIONS, crc_matches


def use_state_store(spark: SparkSession) -> None:
    """Let the session's streams keep state in RocksDB, as processors ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_COUNTS = "source string, pid int, n_packets bigint, cc_errors bigint"
_STATE = "last_cc int, n_packets bigint, cc_errors bigint"


def _ordered(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(by), kind="stable")


def pid_counts(packets: DataFrame) -> DataFrame:
    """Running packets and continuity errors of each PID of decoded packets, by arbitrary state: last counter and sums."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, errors = state.get if state.exists else (-1, 0, 0)
        rows = _ordered(frames, "byte_offset")
        cc, payload = rows["cc"].to_numpy(np.int64), rows["has_payload"].to_numpy(bool)
        step = np.diff(cc, prepend=last) % 16
        wrong = np.where(step == 0, payload, step != 1)
        wrong[0] &= last >= 0
        errors += int(wrong.sum()) if key[1] != NULL_PID else 0
        state.update((int(cc[-1]), n + len(cc), errors))
        yield pd.DataFrame({"source": [key[0]], "pid": [key[1]], "n_packets": [n + len(cc)], "cc_errors": [errors]})

    useful = packets.where("NOT tei").select("source", "pid", "byte_offset", F.col("cc").cast("int").alias("cc"), "has_payload")
    return useful.groupBy("source", "pid").applyInPandasWithState(update, _COUNTS, _STATE, "update", GroupStateTimeout.NoTimeout)


class Assembler:
    """The sections of one PID, packet by packet: the bytes since the last start that are not yet a section, and the last counter."""

    def __init__(self, pending: bytes | None = None, first_offset: int | None = None, place: int = 0, last_cc: int = -1):
        self.pending, self.first_offset, self.place, self.last_cc = pending, first_offset, place, last_cc

    def _whole(self) -> Iterator[tuple]:
        """Sections that the pending bytes begin with; stuffing or an impossible length ends the run."""
        data, at = self.pending or b"", 0
        while at + 3 <= len(data):
            n = (data[at + 1] & 0x0F) << 8 | data[at + 2]
            if data[at] == 0xFF or not 0 < n <= MAX_LENGTH:
                self.pending = None
                return
            if at + 3 + n > len(data):
                break
            yield self.first_offset, self.place, data[at : at + 3 + n]
            self.place += 1
            at += 3 + n
        self.pending = None if data[at : at + 1] == b"\xff" else data[at:]

    def push(self, offset: int, cc: int, starts: bool, jump: bool, payload: bytes) -> Iterator[tuple]:
        """(first_offset, place, section) of what this packet completes."""
        if jump or (self.last_cc >= 0 and (cc - self.last_cc) % 16 != 1):
            self.pending = None
        self.last_cc = cc
        if starts:
            if self.pending is not None:
                self.pending += payload[1 : 1 + payload[0]]
                yield from self._whole()
            self.pending, self.first_offset, self.place = payload[1 + payload[0] :], offset, 0
            yield from self._whole()
        elif self.pending is not None:
            self.pending += payload
            yield from self._whole()


_SECTION_NAMES = [f.split()[0] for f in SECTIONS.split(", ")]


def _section_rows(source: str, found: list[tuple]) -> dict:
    """Columns of SECTIONS for (pid, first_offset, place, section) tuples."""
    whole = [x[3] for x in found]
    return {
        "source": [source] * len(found), "pid": [x[0] for x in found], "first_offset": [x[1] for x in found], "place": [x[2] for x in found], "section": whole,
        "table_id": [x[0] for x in whole], "crc32": [int.from_bytes(x[-4:], "big") for x in whole], "crc_ok": [x[0] in NO_CRC or crc_matches(x) for x in whole],
    }


_ASSEMBLER = "pending binary, first_offset bigint, place int, last_cc int"


def _values(row: tuple) -> tuple:
    """A row of state whose first value is bytes."""
    return None if row[0] is None else bytes(row[0]), *row[1:]


def _restored(row: tuple) -> Assembler:
    return Assembler(*_values(row))


def _kept(a: Assembler) -> tuple:
    return a.pending, a.first_offset, a.place, a.last_cc


def _payloads(packets: DataFrame) -> DataFrame:
    useful = packets.where("NOT tei AND has_payload AND scrambling = 0 AND pid <> 8191 AND payload IS NOT NULL")
    return useful.select("source", "pid", "byte_offset", F.col("cc").cast("int").alias("cc"), "pusi", F.coalesce("discontinuity", F.lit(False)).alias("discontinuity"), "payload")


class _Processor(StatefulProcessor):
    """A processor whose key has one row of state."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("own", self.state)

    def close(self) -> None:
        pass


class _Sections(_Processor):
    state = _ASSEMBLER

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        assembler = _restored(self.value.get()) if self.value.exists() else Assembler()
        rows = _ordered(rows, "byte_offset")
        values = zip(rows["byte_offset"], rows["cc"], rows["pusi"], rows["discontinuity"], map(bytes, rows["payload"]))
        found = [(key[1], *x) for value in values for x in assembler.push(*value)]
        self.value.update(_kept(assembler))
        if found:  # a frame without rows has no types
            yield pd.DataFrame(_section_rows(key[0], found))


def sections(packets: DataFrame) -> DataFrame:
    """Sections of decoded packets across micro-batches, as `sections.reassemble` gives them."""
    return _payloads(packets).groupBy("source", "pid").transformWithStateInPandas(_Sections(), SECTIONS, "Append", "None")


class _Changed(_Processor):
    state = "last bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, "first_offset", "place")
        before = rows["crc32"].shift(1)
        if self.value.exists():
            before.iloc[0] = self.value.get()[0]
        self.value.update((int(rows["crc32"].iloc[-1]),))
        yield rows[rows["crc32"] != before][_SECTION_NAMES]


def changed_tables(found: DataFrame) -> DataFrame:
    """Sound sections whose CRC is not that of the one before on their PID, across micro-batches."""
    return found.where("crc_ok").select(*_SECTION_NAMES).groupBy("source", "pid").transformWithStateInPandas(_Changed(), SECTIONS, "Append", "None")


def _slot(kind: str) -> Column:
    """The bytes of a section that name its slot: ids, and the section's number and last number."""
    s = F.col("section")
    places = {"NIT": [(3, 2), (6, 2)], "BAT": [(3, 2), (6, 2)], "SDT": [(3, 2), (8, 2), (6, 2)], "EIT": [(0, 1), (3, 2), (6, 2)]}[kind]
    return F.hex(F.concat(*(part(s, at, n) for at, n in places)))


class _Versions(_Processor):
    state = "last int"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _ordered(rows, "first_offset", "place")
        version = rows["version"].to_numpy(np.int64)
        last = self.value.get()[0] if self.value.exists() else -1
        self.value.update((int(version[-1]),))
        yield rows[np.diff(version, prepend=last) != 0][_SECTION_NAMES]


def new_versions(found: DataFrame, kind: str) -> DataFrame:
    """Sections of a kind (NIT, BAT, SDT, EIT; of that kind only) whose version is not the one their slot holds, across micro-batches."""
    keyed = found.where("crc_ok").select(*_SECTION_NAMES, _slot(kind).alias("slot"), bits(F.col("section"), 5, 2, 5).cast("int").alias("version"))
    return keyed.groupBy("source", "pid", "slot").transformWithStateInPandas(_Versions(), SECTIONS, "Append", "None")


# Types of elementary streams, and the descriptor that signals applications.
_PRIVATE, _CUES, _APPLICATIONS = 0x05, 0x86, 0x6F


class Announced:
    """The PIDs that a source's tables announce, and the sections on them from the packet behind the announcement on.

    owners: for each PID, by which PIDs it is announced (PAT: 0), as what kind. A table that no longer names a PID, or goes itself, takes its announcement back.
    """

    def __init__(self):
        self.assemblers: dict[int, Assembler] = {0: Assembler()}
        self.owners: dict[int, dict[int, str]] = {}
        self.parts: dict[int, dict[int, list[int]]] = {}
        self.version = -1

    def kind(self, pid: int) -> str:
        return "PAT" if pid == 0 else min(self.owners[pid].items())[1]

    def push(self, pid: int, *packet) -> list[tuple]:
        """(kind, pid, first_offset, place, section) of what a packet completes."""
        if pid not in self.assemblers:
            return []
        kind, out = self.kind(pid), []
        for found in self.assemblers[pid].push(*packet):
            out.append((kind, pid, *found))
            section = found[2]
            if len(section) >= 12 and crc_matches(section) and section[5] & 1:
                if kind == "PAT" and section[0] == 0:
                    self._pat(section)
                elif kind == "PMT" and section[0] == 2:
                    self._announce(pid, self._streams(section))
        return out

    def _pat(self, section: bytes) -> None:
        version, number = section[5] >> 1 & 31, section[6]
        if version != self.version:
            self.version, self.parts = version, {}
        entries = [section[k : k + 4] for k in range(8, len(section) - 7, 4)]
        self.parts.setdefault(0, {})[number] = [(e[2] & 31) << 8 | e[3] for e in entries if e[:2] != b"\0\0"]
        if len(self.parts[0]) > section[7]:
            self._announce(0, {p: "PMT" for own in self.parts[0].values() for p in own})

    @staticmethod
    def _streams(section: bytes) -> dict[int, str]:
        at, end, first, out = 12 + ((section[10] & 15) << 8 | section[11]), len(section) - 4, {}, {}
        while at + 5 <= end:
            kind, pid, n = section[at], (section[at + 1] & 31) << 8 | section[at + 2], (section[at + 3] & 15) << 8 | section[at + 4]
            loop, k, tags = section[at + 5 : at + 5 + n], 0, set()
            while k + 2 <= len(loop):
                tags.add(loop[k])
                k += 2 + loop[k + 1]
            new = kind not in first
            first.setdefault(kind, pid)
            if kind == _CUES and new:
                out[pid] = "SCTE-35"
            elif kind == _PRIVATE and _APPLICATIONS not in tags:
                out[pid] = "EWS"
            elif kind == _PRIVATE and new:
                out[pid] = "AIT"
            at += 5 + n
        return out

    def _announce(self, owner: int, pids: dict[int, str]) -> None:
        for pid, kind in pids.items():
            self.owners.setdefault(pid, {})[owner] = kind
            self.assemblers.setdefault(pid, Assembler())
        for pid in [p for p, own in self.owners.items() if owner in own and p not in pids]:
            del self.owners[pid][owner]
            if not self.owners[pid]:
                del self.owners[pid], self.assemblers[pid]
                self._announce(pid, {})


class _Announcements(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pids = handle.getMapState("pids", "pid int", f"owners array<struct<owner:int,kind:string>>, {_ASSEMBLER}")
        self.pat = handle.getValueState("pat", "version int, parts array<struct<number:int,pids:array<int>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = Announced()
        for (pid,), (owners, *assembler) in self.pids.iterator():
            known.assemblers[pid] = _restored(tuple(assembler))
            if pid:
                known.owners[pid] = {o["owner"]: o["kind"] for o in owners}
        if self.pat.exists():
            known.version, parts = self.pat.get()
            known.parts = {0: {p["number"]: list(p["pids"]) for p in parts}}
        before = set(known.assemblers)
        rows = _ordered(rows, "byte_offset")
        values = zip(rows["pid"], rows["byte_offset"], rows["cc"], rows["pusi"], rows["discontinuity"], rows["payload"])
        found = [x for pid, *head, payload in values if pid in known.assemblers for x in known.push(pid, *head, bytes(payload))]
        for pid in before - set(known.assemblers):
            self.pids.removeKey((pid,))
        for pid, assembler in known.assemblers.items():
            self.pids.updateValue((pid,), ([(o, kind) for o, kind in sorted(known.owners.get(pid, {}).items())], *_kept(assembler)))
        self.pat.update((known.version, [(n, pids) for n, pids in sorted(known.parts.get(0, {}).items())]))
        if found:
            yield pd.DataFrame({"kind": [x[0] for x in found]} | _section_rows(key[0], [x[1:] for x in found]))

    def close(self) -> None:
        pass


def announced_sections(packets: DataFrame) -> DataFrame:
    """Sections of the PAT and of all PIDs that it and the PMTs announce (kind: PAT, PMT, AIT, SCTE-35, EWS), from the announcement on, across micro-batches.

    A source's packets come to one task, which passes over those of other PIDs.
    """
    return _payloads(packets).groupBy("source").transformWithStateInPandas(_Announcements(), f"kind string, {SECTIONS}", "Append", "None")


_RATES = "source string, pid int, byte_offset bigint, n_bytes bigint, n_useful bigint, ticks bigint"
_RATE_NAMES = [f.split()[0] for f in _RATES.split(", ")]


class Rates:
    """Open windows of a source: begin, bytes and useful bytes of each PID, or of the stream under None."""

    def __init__(self, options: RateOptions, per_pid: bool, reference: int | None = None, open_: dict | None = None):
        self.window, self.width, self.size, self.per_pid = options.window_ticks, options.width, options.packet_size, per_pid
        self.reference = options.reference_pid if reference is None else reference
        self.open = open_ or {}

    def push(self, pid: int, offset: int, tick: int | None, jump: bool) -> list[tuple]:
        """(pid, offset, bytes, useful bytes, ticks) of the windows that a packet closes."""
        key = pid if self.per_pid else None
        begin, n, useful = self.open.get(key, (None, 0, 0))
        self.open[key] = begin, n + self.size, useful + (0 if pid == NULL_PID else self.size)
        if self.reference is None and tick is not None:
            self.reference = pid
        if jump and pid == self.reference:
            self.open = dict.fromkeys(self.open, (None, 0, 0))
        elif jump and self.per_pid:
            self.open[key] = None, 0, 0
        if tick is None or pid != self.reference:
            return []
        out = []
        for own, (begin, n, useful) in self.open.items():
            if begin is None:
                self.open[own] = tick, n, useful
            elif n and (delta := (tick - begin) % (1 << self.width)) >= self.window:
                out.append((own, offset, n, useful, delta))
                self.open[own] = tick, 0, 0
        return out


class _RateWindows(StatefulProcessor):
    def __init__(self, options: RateOptions, per_pid: bool):
        self.options, self.per_pid = options, per_pid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reference = handle.getValueState("reference", "pid int")
        self.windows = handle.getMapState("windows", "pid int", "begin bigint, n bigint, useful bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_ = {None if pid < 0 else pid: tuple(v) for (pid,), v in self.windows.iterator()}
        rates = Rates(self.options, self.per_pid, self.reference.get()[0] if self.reference.exists() else None, open_)
        rows = _ordered(rows, "byte_offset")
        ticks = (None if t < 0 else int(t) for t in rows["tick"])
        found = [x for v in zip(rows["pid"].tolist(), rows["byte_offset"].tolist(), ticks, rows["jump"].tolist()) for x in rates.push(*v)]
        if rates.reference is not None:
            self.reference.update((rates.reference,))
        for pid, v in rates.open.items():
            self.windows.updateValue((-1 if pid is None else pid,), v)
        if not found:
            return
        values = np.array([(-1 if x[0] is None else x[0], *x[1:]) for x in found], np.int64).reshape(-1, 5)
        yield pd.DataFrame({"source": [key[0]] * len(found)} | dict(zip(_RATE_NAMES[1:], values.T)))

    def close(self) -> None:
        pass


def rate_windows(packets: DataFrame, options: RateOptions | None = None, per_pid: bool = False) -> DataFrame:
    """Rate windows of each source's stream (pid null) or of its PIDs across micro-batches, as `analyzer.bitrate` closes them; the reference PID is the first with a tick."""
    options = options or RateOptions()
    counted = packets.where("NOT tei") if options.include_null else packets.where((~F.col("tei")) & (F.col("pid") != NULL_PID))
    rows = counted.select("source", "pid", "byte_offset", F.coalesce(options.tick, F.lit(-1)).cast("bigint").alias("tick"), F.coalesce("discontinuity", F.lit(False)).alias("jump"))
    found = rows.groupBy("source").transformWithStateInPandas(_RateWindows(options, per_pid), _RATES, "Append", "None")
    return found.withColumn("pid", F.when(F.col("pid") >= 0, F.col("pid")))


class Carrier(Assembler):
    """The T2-MI packets of one PID, packet by packet."""

    def _whole(self) -> Iterator[tuple]:
        data, at = self.pending or b"", 0
        for unit in t2mi.cut_packets(data):
            yield self.first_offset, self.place, unit
            self.place += 1
            at += len(unit)
        self.pending = data[at:] if t2mi.may_begin(data[at:]) else None


class _Carriers(_Processor):
    state = _ASSEMBLER

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        carrier = Carrier(*_values(self.value.get())) if self.value.exists() else Carrier()
        rows = _ordered(rows, "byte_offset")
        values = zip(rows["byte_offset"], rows["cc"], rows["pusi"], map(bytes, rows["payload"]))
        found = [x for offset, cc, starts, payload in values for x in carrier.push(offset, cc, starts and len(payload) > 0, False, payload)]
        self.value.update(_kept(carrier))
        if found:
            fixed = {"source": [key[0]] * len(found), "pid": [key[1]] * len(found), "first_offset": [x[0] for x in found], "place": [x[1] for x in found]}
            yield pd.DataFrame(fixed | {"packet": [x[2] for x in found], "crc_ok": [crc_matches(x[2]) for x in found]})


def carrier_packets(packets: DataFrame) -> DataFrame:
    """T2-MI packets of decoded packets (of carriers' PIDs only) across micro-batches, as `t2mi.carrier_packets` gives them; `t2mi.baseband_frames` takes them."""
    useful = packets.where("NOT tei AND payload IS NOT NULL").select("source", "pid", "byte_offset", F.col("cc").cast("int").alias("cc"), "pusi", "payload")
    return t2mi.of_packets(useful.groupBy("source", "pid").transformWithStateInPandas(_Carriers(), t2mi.UNITS, "Append", "None"))


class _Plps(_Processor):
    state = "rest binary, size int, mode int, deleted boolean, n bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stripper = t2mi.Stripper(*_values(self.value.get())) if self.value.exists() else t2mi.Stripper()
        rows = _ordered(rows, "first_offset", "place")
        values = zip(map(bytes, rows["data"]), rows["syncd"].tolist(), rows["upl"].tolist(), rows["mode"].tolist(), rows["null_deleted"].tolist())
        found = [x for value in values for x in stripper.push(*value)]
        self.value.update(stripper.state())
        if found:
            fixed = {"source": [key[0]] * len(found), "pid": [key[1]] * len(found), "plp_id": [key[2]] * len(found)}
            yield pd.DataFrame(fixed | dict(zip(("number", "nulls", "raw"), map(list, zip(*found)))))


def inner_packets(frames: DataFrame) -> DataFrame:
    """The packets in each PLP's frames across micro-batches, as `t2mi.inner_packets` gives them; one that is torn over frames comes with the next start."""
    useful = t2mi.usable(frames).select("source", "pid", "plp_id", "first_offset", "place", "data", "syncd", "upl", "mode", "null_deleted")
    return t2mi.with_nulls(useful.groupBy("source", "pid", "plp_id").transformWithStateInPandas(_Plps(), t2mi.CUT, "Append", "None"))


def windowed_bytes(packets: DataFrame, time: str = "ingested", width: str = "1 second", late: str = "10 seconds", packet_size: int = 188) -> DataFrame:
    """Bytes of each PID in tumbling windows of arrival time, with a watermark for late packets."""
    return packets.withWatermark(time, late).groupBy(F.window(time, width), "source", "pid").agg((F.count("*") * packet_size).alias("n_bytes"))


def read_live(spark, path: str, **options) -> DataFrame:
    """Decoded packets of a folder's new files."""
    from muxlake.sources.ts import register

    register(spark)
    return decode(spark.readStream.format("ts").options(**options).load(path))
